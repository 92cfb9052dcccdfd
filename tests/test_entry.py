"""The registered queries against their SQL, on the smallest tables; the llm folders may be absent."""

import ast
import os
from collections import Counter
from pathlib import Path

import pytest

from tessera.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _norm(x):
    if isinstance(x, float):
        return round(x, 6)
    if isinstance(x, (list, tuple)):
        return tuple(map(_norm, x))
    return x


@pytest.fixture(scope="module")
def duck():
    import duckdb

    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


#: One query of each family here; the driver runs them all.
CORE = ["gr7_causal_paths", "gr1_upsert_entities", "gr4_neighbors_nodes", "gr8_scoped_causal", "agg1_graph_stats", "idx2_bm25", "idx5_vector_top_k", "idx12_rank_flattening", "ev1_prf", "ev3_retrieval", "txt3_confusions", "txt7_stable_hash", "chk2_item_chunks", "aln2_cascade", "jn8_edge_resolution", "qa1_hybrid_fusion", "qg1_questions", "str2_state_changes", "str4_read_through"]


@pytest.mark.parametrize("name", CORE)
def test_query_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(_norm(r[c]) for c in cols)) for r in df.collect())
    res = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    want = sorted(repr(tuple(_norm(r[names.index(c)]) for c in cols)) for r in res.fetchall())
    assert got == want


@pytest.mark.parametrize("name", ["idx4_provider_vectors", "ext10_outlasting_provider", "qa6_natural_answers"])
def test_each_query_has_its_own_provider(spark, duck, name):
    test_query_equals_sql(spark, duck, name)


@pytest.mark.parametrize("name", ["gen6_draws", "gr10_material_branch", "src5_ontology", "gr12_answer_graph", "idx11_graph_candidates", "qa2_online_answer", "idx2_segmented_bm25", "idx9_chunk_candidates", "ev7_ablation", "ev8_per_question", "src8_saved_index", "idx7_link_entities"])
def test_reworked_query_equals_sql(spark, duck, name):
    test_query_equals_sql(spark, duck, name)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_no_module_defines_a_name_twice():
    root, twice = Path(__file__).parents[1], []
    for file in [root / "__spark_entry__.py", root / "corpus_pipeline.py", *root.glob("tessera/**/*.py")]:
        if file.exists():
            names = Counter(n.name for n in ast.parse(file.read_text()).body if isinstance(n, (ast.FunctionDef, ast.ClassDef)))
            twice += [(file.name, n) for n, k in names.items() if k > 1]
    assert not twice
