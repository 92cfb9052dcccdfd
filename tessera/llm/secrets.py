"""Secret scans: fixed patterns, and a guess-cost dynamic program over values in credential contexts.

Three base kinds are found by pattern: ``assign`` (a credential name, a separator and a value of
8 characters or more), ``access`` (key ids) and ``hex`` (long hexadecimal runs). Around wider credential
contexts the method takes the value and finds the cheapest way to guess it: a segmentation into
dictionary words, dates, repeats, keyboard walks and brute-force characters whose summed log10
guesses are least. A letter by brute force costs what the letter pairs of the dictionary say after the letter before it, or one of 26 if that is less, so
a run that can be spoken costs by its length, and five words cost five words (five or more run together are a passphrase, however common). Values that stay expensive are added as kind ``guess``; base
spans always stay. Code that fetches a value (``os.environ.get(``, ``headers[``, a dotted name of letters) and URLs
without credentials are no values.

The dictionary is the fixed list of password words and word parts, and all words of the documents that ``LEAST_DOCS`` of them have outside
credential contexts, whatever their number and length; a word's rank is the number of words that at least as many documents have. It is a written table
that nothing broadcasts (the joins ask for shuffles, since their sides grow with the input): the distinct values' substrings are joined to it. Whether a value is a secret depends on the value and the
dictionary alone, so each is priced once.

Defined results: a null text counts as empty (no spans); repeated rows give repeated results; a
text of any length is scanned whole; extra columns are dropped (``redact`` keeps them); an empty table gives an empty
result; words that fewer than ``LEAST_DOCS`` rows have are not in the dictionary. One map over the texts, one count of
words, combined before its shuffle, and joins of what the contexts hold.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import log10

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tessera.llm.common import materialise, portions, table

KINDS = ("assign", "access", "hex", "guess")
#: log10 of the guesses from which a value counts as a secret, and its least length.
THRESHOLD, SHORTEST = 10.0, 6
#: Words of the dictionary are in so many documents at least.
LEAST_DOCS = 5

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
#: Wider contexts: more names, as parts of longer names too (DB_PASSWORD, secretAccessKey), arrows and "is",
#: bearer headers, and passwords inside URLs, whose user may be empty. A value ends at "@" in a URL only, and does not begin as a URL.
_CONTEXT = re.compile(
    r"""(?:(?:(?<![a-z])|(?-i:(?<=[a-z])(?=[A-Z])))(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|(?:api|access|private|auth|encryption|client)[_.-]?(?:key|secret|token))(?:[_.-]?(?:access|key|id|value|base|hash|text|string|secret|token|[0-9]+))*+["'`]?\s{0,2}(?::=|=>|->|[:=]|\bis\b)\s{0,2}["'`]?|\bbearer\s+)(?![a-z][a-z0-9+.-]*://)([^\s"'`,;<>]{6,})|://[^\s:/@]*+:([^\s"'`,;<>@]{6,})""",
    re.I | re.A,
)

#: Common password words, most frequent first: fixed values, their place is their rank.
WORDS = (
    "password the and you that pass word love admin qwerty welcome monkey dragon master login hello letmein shadow sunshine princess football "
    "baseball superman batman trustno iloveyou secret token key user test guest root default change changeme please server database access "
    "system private public example sample your here none null true false required value string enter insert account email name service "
    "client auth api summer winter spring autumn january february march april may june july august september october november december "
    "monday tuesday friday star wars computer internet freedom michael jordan thomas daniel jessica ashley charlie george hunter killer "
    "soccer hockey ranger buster tigger cookie ginger pepper flower orange purple silver golden black white green yellow red blue "
    "with from this have not for are was but all can one out day get has him his how man new now old see two way who boy did its let put say she too use"
).split()
#: Parts of the words of English, German, French and Spanish, fixed values too; they rank after the words.
PARTS = (
    "ation tion sion ment ness able ible ical ally ized izing ization inter national nation trans under over pre pro con com dis mis non sub super "
    "ing ers est ful less ous ive ity ance ence ant ary ory ure ish ship hood ward wise ologie ology graph gram phone meter "
    "port form tain struct ject press serv duct cept tract vers some any thing every body where "
    "ung ungen keit heit lich lichkeit igkeit isch schaft ieren ver trau ent auf aus ein vor nach zer wieder zusammen sicher "
    "eux euse ement eur trice ique isme age aire con des dad ciones amiento mente ado ido ante ista"
).split()
_PARTS = frozenset(PARTS)
_RANK = {w: i + 1 for i, w in reversed(list(enumerate([*WORDS, *PARTS])))}
#: Letters that the pair model knows, which bounds it; any other is one of 26.
_LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xDF, 0x100)))
#: Runs of letters that the pair model prices: of so many letters, in one case or with a capital first.
SPOKEN = 4
_SPOKEN = re.compile(rf"[A-Z\u00C0-\u00D6\u00D8-\u00DE]?[{_LETTERS}]{{{SPOKEN},}}|[A-Z\u00C0-\u00D6\u00D8-\u00DE]{{{SPOKEN},}}")
#: Words run together that make a passphrase.
PHRASE = 5
#: What a context without a credential looks like: fetching code, and dotted names of letters.
_CODE = re.compile(r"[A-Za-z_.]+[(\[][A-Za-z_.()\[\]]*|[A-Za-z_]+(?:\.[A-Za-z_]+)+")
#: Rows of a keyboard; a walk steps to a neighbour in its row.
_ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "abcdefghijklmnopqrstuvwxyz")
_NEXT = {(a, b) for row in _ROWS for a, b in zip(row, row[1:], strict=False)} | {(b, a) for row in _ROWS for a, b in zip(row, row[1:], strict=False)}
_LEET_FROM, _LEET_TO = "4@301!5$7", "aaeoiisst"
_LEET = str.maketrans(_LEET_FROM, _LEET_TO)
_DATE = re.compile(r"(?:19|20)\d\d([-/._]?)(?:1[0-2]|0?[1-9])\1(?:3[01]|[12]\d|0?[1-9])|(?:3[01]|[12]\d|0?[1-9])([-/._]?)(?:1[0-2]|0?[1-9])\2(?:19|20)\d\d|(?:19|20)\d\d")


def _char_cost(c: str) -> float:
    """log10 of the guesses for one character by brute force."""
    return 1.0 if c.isdigit() else log10(26) if c.islower() or c.isupper() else log10(33)


def ranked(words: list[str]) -> dict[str, int]:
    """Ranks of the fixed words and of ``words``, the most frequent first; the better of two."""
    ranks = {w: i + 1 for i, w in enumerate(words)}
    return ranks | {w: min(r, ranks.get(w, r)) for w, r in _RANK.items()}


def letter_costs(pairs: Counter | None = None) -> dict[str, dict[str, float]]:
    """log10 guesses of each letter after another (after " " at the start), by the pairs in the fixed words and ``pairs``; "" for any other pair."""
    counted: dict[str, Counter] = {"": Counter()}
    for a, b in ((a, b) for w in _RANK for a, b in zip(" " + w, w, strict=False)):
        counted.setdefault(a, Counter())[b] += 1
    for (a, b), n in (pairs or {}).items():
        counted.setdefault(a, Counter())[b] += n
    rare = 0.3  # of each pair that no word has
    out = {}
    for a, found in counted.items():
        total = log10(found.total() + 27 * rare)
        out[a] = {b: total - log10(n + rare) for b, n in found.items()} | {"": total - log10(rare)}
    return out


def word_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n): in how many rows each word of three letters or more stands, if in LEAST_DOCS or more.

    Values in credential contexts do not count, so a secret that copies share is not a word.
    """
    text = F.col(text_col)
    bare = F.regexp_replace(F.regexp_replace(text, "(?i)" + _ASSIGN.pattern, " "), "(?i)" + _CONTEXT.pattern, " ")
    named = F.lower(text).rlike("pass|pwd|secret|token|credential|key|bearer|://")
    words = F.regexp_extract_all(F.lower(F.when(named, bare).otherwise(text)), F.lit(r"(?U)\b(\p{L}{3,})\b"), F.lit(1))
    counted = df.select(F.explode(F.array_distinct(words)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where((F.col("n") >= LEAST_DOCS) & ~F.col("word").rlike(r"^(.)\1*$"))


def dictionary(df: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, rank): the words of ``word_counts``; the rank is the number of words that at least as many rows have. Written once."""
    counted = materialise(word_counts(df, text_col), "words")
    sizes = counted.groupBy("n").agg(F.count(F.lit(1)).alias("words"))  # as many rows as there are different counts
    ranks = sizes.select("n", F.sum("words").over(Window.orderBy(F.desc("n"))).alias("rank"))
    return counted.join(ranks, "n").select("word", "rank")


def pair_counts(words: DataFrame) -> Counter:
    """Letter pairs (and first letters, after a space) of the words of a dictionary, of the letters that the model knows: 3,600 at most."""
    spaced = F.concat(F.lit(" "), F.col("word"))
    pairs = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.substring(spaced, i, F.lit(2)))).alias("p"))
    known = pairs.where(F.col("p").rlike(f"^[ {_LETTERS}][{_LETTERS}]$")).groupBy("p").agg(F.count(F.lit(1)).alias("n"))
    return Counter({(r.p[0], r.p[1]): r.n for r in known.collect()})


def brute_costs(value: str, letters: dict[str, dict[str, float]] | None) -> list[float]:
    """log10 guesses of each character of a value by brute force; with ``letters`` those within SPOKEN letters or more of one case, or with a capital first, by their pairs if that is less."""
    out = [_char_cost(c) for c in value]
    for m in _SPOKEN.finditer(value) if letters else ():
        before = " "
        for i in range(*m.span()):
            after, c = letters.get(before) or letters[""], value[i].lower()
            out[i] = min(out[i], after.get(c, after[""]) + (log10(2) if c != value[i] else 0))
            before = c
    return out


def is_secret(value: str, ranks: dict[str, int] = _RANK, letters: dict[str, dict[str, float]] | None = None, threshold: float = THRESHOLD) -> bool:
    """Whether a value costs as many guesses as the threshold, or is PHRASE words or more run together, however common they are."""
    cost, pieces = guess_cost(value, ranks, None, letters)
    return cost >= threshold or value.isalpha() and sum(kind == "word" and end - start >= 4 and value[start:end].lower() not in _PARTS for kind, start, end in pieces) >= PHRASE


def guess_cost(value: str, ranks: dict[str, int] = _RANK, longest: int | None = None, letters: dict[str, dict[str, float]] | None = None) -> tuple[float, list[tuple[str, int, int]]]:
    """Least log10 guesses for ``value``, and the segmentation (kind, start, end) that attains it.

    best[i] is the least cost of the first i characters; each segment adds its own log10 guesses and
    a small charge for one more piece in the order of pieces. Every part of three characters or more of a
    repeat or walk may be a segment. Time is linear in the length: no other segment is longer than ``longest``
    (the longest word, or a date), so beyond that many characters from where a run begins, a segment that began
    earlier in the run is as cheap as any longer one from there. With ``letters`` (``letter_costs``) a letter by brute
    force costs no more than after the letter before it, a capital twice as many guesses.
    """
    longest = max(10, longest or max(map(len, ranks)))
    n, low = len(value), value.lower()
    plain = low.translate(_LEET)
    best, back = [0.0] + [float("inf")] * n, [("", 0)] * (n + 1)
    step = log10(2)

    def offer(kind: str, i: int, j: int, cost: float) -> None:
        if best[i] + cost < best[j]:
            best[j], back[j] = best[i] + cost, (kind, i)

    def offer_parts(kind: str, i: int, begin: int, end: int, cost: float) -> None:
        for j in range(i + 3, (end if i - begin <= longest else min(end, i + longest)) + 1):
            offer(kind, i, j, cost + log10(j - i) + step)

    # ends of the runs of one character and of keyboard walks that begin at each place
    same, walk = list(range(1, n + 1)), list(range(1, n + 1))
    for i in range(n - 2, -1, -1):
        if value[i] == value[i + 1]:
            same[i] = same[i + 1]
        if (low[i], low[i + 1]) in _NEXT:
            walk[i] = walk[i + 1]
    first_same = first_walk = 0
    by_letter = brute_costs(value, letters)
    for i in range(n):
        if i and same[i] != same[i - 1]:
            first_same = i
        if i and walk[i] != walk[i - 1]:
            first_walk = i
        offer("brute", i, i + 1, by_letter[i])
        offer_parts("repeat", i, first_same, same[i], _char_cost(value[i]))
        offer_parts("walk", i, first_walk, walk[i], log10(40))
        for j in range(i + 3, min(n, i + longest) + 1):
            rank = ranks.get(low[i:j])
            if rank is not None:
                offer("word", i, j, log10(rank + 1) + (0 if value[i:j] == low[i:j] else step) + step)
            elif (rank := ranks.get(plain[i:j])) is not None:
                offer("word", i, j, log10(rank + 1) + 3 * step)
        if value[i].isdigit() and (m := _DATE.match(value, i, i + 10)):
            offer("date", i, m.end(), log10(365 * 100 if m.end() - i > 4 else 200) + step)
    pieces, j = [], n
    while j:
        kind, i = back[j]
        if pieces and kind == "brute" and pieces[-1][0] == "brute":
            pieces[-1] = ("brute", i, pieces[-1][2])
        else:
            pieces.append((kind, i, j))
        j = i
    return best[n], pieces[::-1]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place in KINDS, end) of the base kinds."""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    return found + [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]


def context_values(text: str) -> list[tuple[int, int, str]]:
    """(start, end, value) of what credential contexts hold, unless it is code or too short."""
    out = []
    for m in _CONTEXT.finditer(text):
        start, end = m.span(m.lastindex)
        while end > start and text[end - 1] in ".)]}!?:":
            end -= 1
        if end - start >= SHORTEST and not _CODE.fullmatch(text, start, end):
            out.append((start, end, text[start:end]))
    return out


_SPAN = "struct<start: int, kind: int, end: int>"
_VALUE = "struct<start: int, end: int, value: string>"


def _marked(df: DataFrame, text_col: str, keep_text: bool) -> DataFrame:
    """``df`` with a unique number of each row, its base spans and its context values; written, so that the numbers stay."""
    k = df.columns.index(text_col)
    kept = [f for i, f in enumerate(df.schema) if keep_text or i != k]
    added = T.StructType.fromDDL(f"_row long, _base array<{_SPAN}>, _values array<{_VALUE}>")
    out = T.StructType([*kept, *added])
    types = to_arrow_schema(added).types

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in (x for whole in batches for x in portions(whole, k)):
            base, values = [], []
            for text in batch.column(k).to_pylist():
                base.append([{"start": s, "kind": kind, "end": e} for s, kind, e in sorted(base_spans(text))] if text else [])
                values.append([{"start": s, "end": e, "value": v} for s, e, v in context_values(text)] if text else [])
            columns = [c for i, c in enumerate(batch.columns) if keep_text or i != k]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(range(row, row + batch.num_rows), pa.int64()), pa.array(base, types[1]), pa.array(values, types[2])], names=out.names)
            row += batch.num_rows

    return materialise(df.mapInArrow(run, out), "marked")


def judged(values: DataFrame, words: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(value): the distinct ones of ``values`` (value) that cost as many guesses as the threshold, by the words (word, rank) of a dictionary."""
    letters = values.sparkSession.sparkContext.broadcast(letter_costs(pair_counts(words)))
    each = values.select("value").distinct()
    sizes = [r[0] for r in words.select(F.length("word")).distinct().collect()]
    low, plain = F.lower("value"), F.translate(F.lower("value"), _LEET_FROM, _LEET_TO)

    def parts(text):
        of = lambda n: F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, n)))
        return F.flatten(F.transform(F.array(*map(F.lit, sizes)).cast("array<int>"), lambda n: F.coalesce(of(n), F.array().cast("array<string>"))))

    subs = each.select("value", F.explode(F.array_distinct(F.concat(parts(low), parts(plain)))).alias("word"))
    known = subs.join(words.hint("merge"), "word").groupBy("value").agg(F.collect_list(F.struct("word", "rank")).alias("words"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for value, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ranks = dict(_RANK)
                for w in found or ():
                    ranks[w["word"]] = min(w["rank"], ranks.get(w["word"], w["rank"]))
                if is_secret(value, ranks, letters.value, threshold):
                    kept.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.string())], names=["value"])

    return each.join(known.hint("merge"), "value", "left").select("value", "words").mapInArrow(run, "value string")


def _guessed(marked: DataFrame, words: DataFrame, threshold: float) -> DataFrame:
    """(_row, _guess): the spans of secret values of each row that has any."""
    values = marked.select("_row", F.explode("_values").alias("v")).select("_row", "v.*")
    spans = F.collect_list(F.struct("start", F.lit(3).alias("kind"), "end"))
    return values.join(judged(values, words, threshold).hint("merge"), "value").groupBy("_row").agg(spans.alias("_guess"))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, words: DataFrame | None = None) -> DataFrame:
    """(id, spans array<struct<kind, start, end>>): code points, end exclusive, by start and then kind. Without ``words`` (word, rank) those of ``df`` are counted."""
    words = dictionary(df, text_col) if words is None else words
    marked = _marked(df.select(F.col(id_col), F.col(text_col).alias("_text")), "_text", keep_text=False)
    both = marked.join(_guessed(marked, words, threshold).hint("merge"), "_row", "left")
    spans = F.array_sort(F.concat("_base", F.coalesce("_guess", F.array().cast(f"array<{_SPAN}>"))))
    kinds = F.array(*map(F.lit, KINDS))
    return both.select(F.col(id_col), F.transform(spans, lambda x: F.struct(F.get(kinds, x["kind"]).alias("kind"), x["start"].alias("start"), x["end"].alias("end"))).alias("spans"))


def redact(df: DataFrame, text_col: str = "text", mark: str = "[SECRET]", threshold: float = THRESHOLD, words: DataFrame | None = None) -> DataFrame:
    """``df`` with every secret in its text replaced by ``mark``; overlapping spans become one. Null stays null. ``words`` as in ``scan``.

    Only rows with context values are joined with what is found about them; the rest pass in place.
    """
    words = dictionary(df, text_col) if words is None else words
    k = df.columns.index(text_col)
    own = df.toDF(*(f"c{i}" for i in range(len(df.columns))))  # no name of the caller's meets one of these
    marked = _marked(own, f"c{k}", keep_text=True)
    none = F.array().cast(f"array<{_SPAN}>")
    held = marked.where(F.size("_values") > 0)
    held = held.join(_guessed(held, words, threshold).hint("merge"), "_row", "left").select(*marked.columns, "_guess")
    rest = marked.where(F.size("_values") == 0).withColumn("_guess", none)
    both = held.unionByName(rest).select(*own.columns, F.array_sort(F.concat("_base", F.coalesce("_guess", none))).alias("_spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for whole in batches for x in portions(whole, k)):
            done = []
            for text, spans in zip(batch.column(k).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                parts, at = [], 0
                for span in spans:
                    if span["start"] >= at:
                        parts += [text[at : span["start"]], mark]
                    at = max(at, span["end"])
                done.append("".join(parts) + text[at:] if text is not None else None)
            out = batch.select(range(batch.num_columns - 1))
            yield out.set_column(k, batch.schema.field(k), pa.array(done, batch.schema.field(k).type))

    return both.mapInArrow(run, df.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: counts and digests of the secrets of every document, from the spans of ``scan``."""
    def joined(kinds):
        return F.array_join(F.transform(F.filter("spans", lambda x: x["kind"].isin(kinds)), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return scan(table(spark, sf_dir, "documents")).select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(list(KINDS[:3])).cast("binary"), 256).alias("base_sha256"), joined(list(KINDS)).alias("spans")
    )
