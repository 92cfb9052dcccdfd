"""Language ID, token counts, secrets, BPE, licences and HTML: brute force, libraries, edge cases."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import bpe, html_text, langid, licenses, secrets, token_counts, wordbpe

ODD = [
    None, "", "   \n\t ", "Hello wörld's <|endoftext|> x", "a<|startoftext|>b<|endoftext|>", "It's 123 !!?? été''s I'LL", "ÀÉÎ Σας ΣΑΣ İx", "a\x1cb\x00c\x85d\xa0e", "日本語テスト é", "aaaa" * 30, "." * 50,
    "abc" * 400, "ſK Å", "<|ENDOFTEXT|>", "x’y—z… €5", "́e", "same row", "same row",
]


def docs(spark, texts, **extra):
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for c, v in extra.items():
        df = df.withColumn(c, F.lit(v))
    return df


@pytest.fixture(scope="module")
def tok():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_file())


def made_up(n, seed=1):
    rng = random.Random(seed)
    parts = ["th", "er", "on", "an", "ing", "é", "ü", "ción", "Qu", "x", "9", "'s", "-", "%%%", "lly", "eau"]
    return [" ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 7))) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_bpe_equals_the_library(spark, tok):
    texts = ODD + made_up(60)
    df = docs(spark, texts, n_tokens=5, ids="clash")
    want = [tok.encode(t or "", add_special_tokens=False).ids for t in texts]
    encoded = bpe.encode(df, bpe.default_file())
    got = {r.doc_id: r for r in encoded.collect()}
    assert all(np.frombuffer(got[i].ids, "<u4").tolist() == w and got[i].n_tokens == len(w) for i, w in enumerate(want))
    decoded = {r.doc_id: r.decoded for r in bpe.decode(encoded, bpe.default_file()).collect()}
    assert all(decoded[i] == tok.decode(w, skip_special_tokens=False) for i, w in enumerate(want))
    assert bpe.round_trip(df.limit(0), bpe.default_file()).count() == 0


def test_pair_check_equals_exact_merging():
    m = wordbpe.load(bpe.default_file())
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("etaoinshr"), rng.integers(1, 14))) for _ in range(3000)]
    ids, counts = m.encode_words(words)
    at = np.concatenate([[0], np.cumsum(counts)])
    for k, w in enumerate(words):
        form = w[:-1] + chr(ord(w[-1]) + 256)
        plain, n = m.exact([form])
        assert ids[at[k] : at[k + 1]].tolist() == plain.tolist() == m.exact_long(form)


def test_small_cache_gives_the_same(spark):
    enc = bpe.Encoder(bpe.default_file(), cache_words=3)
    texts = made_up(40, 4)
    assert list(enc.encode(texts)) == list(bpe.Encoder(bpe.default_file()).encode(texts))


def test_token_counts(spark, tok):
    texts = ODD + made_up(40, 9) + ["word " * 3000]
    got = {r.doc_id: r for r in token_counts.count_tokens(docs(spark, texts, n_bytes=1), bpe.default_file()).collect()}
    for i, t in enumerate(texts):
        n = len(tok.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 2048)
    assert token_counts.count_tokens(docs(spark, ["x"]).limit(0), bpe.default_file()).count() == 0


def _lang_rows(n, seed):
    rng = random.Random(seed)
    parts = {"aa": ["the", "ing", "er", "th"], "bb": ["ção", "ão", "que", "eira"], "cc": ["sch", "ung", "keit", "ü"]}
    return [(i, " ".join("".join(rng.choice(parts[lang]) for _ in range(3)) for _ in range(20)), lang) for i, lang in ((i, rng.choice("abc") * 2) for i in range(n))]


def test_language_id_held_out(spark):
    rows = _lang_rows(400, 3) + [(1000, None, "aa"), (1001, "123 !!", "bb"), (1002, "", None), (1003, "the" * 20000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    model = langid.train(df, steps=60)
    got = {r.doc_id: r for r in langid.predict(df, model).collect()}
    unseen = {r.doc_id for r in df.where(langid.held_out()).select("doc_id").collect() if r.doc_id < 1000}
    right = [got[i].lang_pred == lang for i, _, lang in rows[:400] if i in unseen]
    assert len(right) > 40 and np.mean(right) >= 0.95
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1000, 1001, 1002)) and got[1003].lang_pred == "aa"
    assert all(0 <= r.score <= 1 for r in got.values())
    kept = langid.predict(df, model, keep_rows=True)
    assert set(kept.columns) == {"doc_id", "text", "lang", "lang_pred", "score"} and kept.count() == len(rows)


def test_language_id_without_labels(spark):
    df = docs(spark, ["abc", None]).withColumn("lang", F.lit(None).cast("string"))
    assert langid.train(df) is None
    assert {r.lang_pred for r in langid.predict(df, None).collect()} == {"und"}
    assert langid.predict(df.limit(0), langid.train(df.limit(0))).count() == 0


def test_gradients_of_the_network():
    net = langid.ByteBiGru(["a", "b"], hidden=3, window=5, seed=1)
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    rng = np.random.default_rng(0)
    x, y = rng.integers(1, 256, (5, 4)), rng.integers(0, 2, 4)

    def loss():
        (hf, kf), (hb, kb) = net._run(x, "f"), net._run(x, "b")
        p = net._softmax(hf @ net.p["Wf"] + hb @ net.p["Wb"] + net.p["bias"])
        return -np.log(p[:, np.arange(4), y]).sum(), p, (hf, kf), (hb, kb)

    _, p, (hf, kf), (hb, kb) = loss()
    p[:, np.arange(4), y] -= 1
    grads = {}
    for d, kept in (("f", kf), ("b", kb)):
        net._back(x, d, kept, p @ net.p["W" + d].T, grads)
    for name, at in (("Uf", (1, 4)), ("Ub", (2, 7)), ("Ef", (int(x[1, 1]), 2)), ("cb", (1,))):
        old, e = net.p[name][at], 1e-2
        net.p[name][at] = old + e
        up = loss()[0]
        net.p[name][at] = old - e
        down = loss()[0]
        net.p[name][at] = old
        assert abs((up - down) / (2 * e) - grads[name][at]) < 0.02 * max(1, abs(grads[name][at]))


def test_fast_positions_equal_the_trained_network():
    net = langid.ByteBiGru(["a", "b", "c"], hidden=5, window=9, seed=2)
    x = np.random.default_rng(1).integers(0, 256, (9, 33)).astype(np.uint8)
    (hf, _), (hb, _) = net._run(x, "f"), net._run(x, "b")
    assert np.abs(net.positions(x) - net._softmax(hf @ net.p["Wf"] + hb @ net.p["Wb"] + net.p["bias"])).max() < 1e-5
    texts = [b"abc" * 7, b"", b"z", b"\0a\0"]
    for text, p in zip(texts, net.pooled(texts), strict=True):
        cut = [text[i : i + 9].ljust(9, b"\0") for i in range(0, len(text), 9)]
        each = [q for w in cut for q, byte in zip(net.positions(np.frombuffer(w, np.uint8)[:, None])[:, 0], w, strict=True) if byte]
        assert np.abs(p - (np.mean(each, 0) if each else 0)).max() < 1e-5


def test_language_ties_and_repeated_rows(spark):
    net = langid.ByteBiGru(["aa", "bb"], hidden=2, window=4)
    for k in net.p:
        net.p[k][:] = 0  # both languages are alike everywhere
    df = docs(spark, ["abc def"] * 3 + ["1"]).withColumn("doc_id", F.lit(None).cast("long"))
    rows = langid.predict(df, net).collect()
    assert sorted((r.lang_pred, round(r.score, 6)) for r in rows) == [("aa", 0.5)] * 3 + [("und", 0.0)]


def test_repeated_and_null_ids_are_encoded_and_counted(spark, tok):
    df = docs(spark, ["same text"] * 3 + [None]).withColumn("doc_id", F.lit(None).cast("long")).withColumn("n_tokens", F.lit("clash")).withColumn("s.x", F.lit(1))
    n = len(tok.encode("same text", add_special_tokens=False).ids)
    assert sorted(r.n_tokens for r in bpe.round_trip(df, bpe.default_file()).collect()) == [0, n, n, n]
    assert sorted(r.n_tokens for r in token_counts.count_tokens(df, bpe.default_file()).collect()) == [0, n, n, n]


def base_spans(text):
    """The base kinds, straight from their patterns."""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


def test_secrets_base_spans(spark):
    rng = random.Random(4)
    bits = ["password", "TOKEN", "api_key", "ſecret", " = ", ":", '"', "'", "AKIA", "AKIAQ7", "0123456789abcdef", "deadbeef", "Xy9", " ", "é", "\n", "=", "token=abc", "AB12CD34EF56"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(300)] + [None, "", "password=token : abcdefghij", "a" * 100_000]
    got = {r.doc_id: r.spans for r in secrets.scan(docs(spark, texts, spans=1)).collect()}
    for i, t in enumerate(texts):
        assert [(s.start, secrets.KINDS.index(s.kind), s.end) for s in got[i] if s.kind != "guess"] == base_spans(t or "")
    assert secrets.scan(docs(spark, ["x"]).limit(0)).count() == 0


def brute_cost(value):
    """Guess cost by trying all segmentations into the same pieces, without the shared table."""
    from functools import cache
    from math import log10

    low, plain, step = value.lower(), value.lower().translate(secrets._LEET), log10(2)

    @cache
    def best(i):
        if i == len(value):
            return 0.0
        out = [secrets._char_cost(value[i]) + best(i + 1)]
        j = i + 1
        while j < len(value) and value[j] == value[i]:
            j += 1
        for k in range(i + 3, j + 1):
            out.append(secrets._char_cost(value[i]) + log10(k - i) + step + best(k))
        j = i + 1
        while j < len(value) and (low[j - 1], low[j]) in secrets._NEXT:
            j += 1
        for k in range(i + 3, j + 1):
            out.append(log10(40) + log10(k - i) + step + best(k))
        for j in range(i + 3, len(value) + 1):
            if low[i:j] in secrets._RANK:
                out.append(log10(secrets._RANK[low[i:j]] + 1) + (0 if value[i:j] == low[i:j] else step) + step + best(j))
            if plain[i:j] in secrets._RANK:
                out.append(log10(secrets._RANK[plain[i:j]] + 1) + 3 * step + best(j))
        m = secrets._DATE.match(value, i, i + 10) if value[i].isdigit() else None
        if m:
            out.append(log10(365 * 100 if m.end() - i > 4 else 200) + step + best(m.end()))
        return min(out)

    return best(0)


def test_guess_cost_is_the_least():
    rng = random.Random(6)
    for _ in range(200):
        v = "".join(rng.choice(["password", "Qwerty", "aaaa", "2019-12-31", "x", "7", "p4ss", "!", "dragon", "321"]) for _ in range(rng.randint(1, 5)))
        cost, pieces = secrets.guess_cost(v)
        assert abs(cost - brute_cost(v)) < 1e-9
        assert "".join(v[s:e] for _, s, e in pieces) == v


def brute_parts_cost(value, ranks):
    """Guess cost by trying every segment of every kind, with every part of repeats and walks."""
    from math import log10

    low, plain, step = value.lower(), value.lower().translate(secrets._LEET), log10(2)
    best = [0.0] + [float("inf")] * len(value)
    for j in range(1, len(value) + 1):
        for i in range(j):
            out = [secrets._char_cost(value[i])] if j - i == 1 else []
            if j - i >= 3 and len(set(value[i:j])) == 1:
                out.append(secrets._char_cost(value[i]) + log10(j - i) + step)
            if j - i >= 3 and all(x in secrets._NEXT for x in zip(low[i:j], low[i + 1 : j])):
                out.append(log10(40) + log10(j - i) + step)
            if low[i:j] in ranks:
                out.append(log10(ranks[low[i:j]] + 1) + (0 if value[i:j] == low[i:j] else step) + step)
            elif plain[i:j] in ranks:
                out.append(log10(ranks[plain[i:j]] + 1) + 3 * step)
            m = secrets._DATE.match(value, i, i + 10) if value[i].isdigit() else None
            if m and m.end() == j:
                out.append(log10(365 * 100 if j - i > 4 else 200) + step)
            best[j] = min([best[j], *(best[i] + x for x in out)])
    return best[-1]


def test_guess_cost_takes_parts_of_runs():
    rng = random.Random(8)
    ranks = secrets.ranked(["identifier", "abababababababababab", "aab", "consistency"])
    bits = ["abcde", "football", "aaaa", "321", "2019-12-31", "ab" * 12, "a" * 40, "qwerty", "identifier", "7", "!", "S3cret", "ba" * 20]
    assert abs(secrets.guess_cost("abcdefootball")[0] - brute_parts_cost("abcdefootball", secrets._RANK)) < 1e-9
    assert secrets.guess_cost("abcdefootballabcdefootball")[0] < secrets.THRESHOLD
    for _ in range(200):
        v = "".join(rng.choice(bits) for _ in range(rng.randint(1, 5)))
        cost, pieces = secrets.guess_cost(v, ranks)
        assert abs(cost - brute_parts_cost(v, ranks)) < 1e-9
        assert "".join(v[s:e] for _, s, e in pieces) == v


def test_ordinary_words_are_not_secrets(spark):
    prose = ["the secret is wonderful", "The password is important for users", "my token: internationalization", "token = something", "secret: Vertraulichkeit", "das passwort pwd: Sicherheit"]
    rng = random.Random(3)
    odd = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(14)) for _ in range(200)]
    mixed = ["".join(rng.choice("abcXYZ012!$efgKLM789qrs") for _ in range(12)) for _ in range(200)]
    got = {r.doc_id: [s for s in r.spans if s.kind == "guess"] for r in secrets.scan(docs(spark, prose + ["the secret is " + x for x in odd + mixed])).collect()}
    assert not any(got[i] for i in range(len(prose)))
    assert sum(map(bool, (got[len(prose) + i] for i in range(200)))) >= 190
    assert all(got[len(prose) + 200 + i] for i in range(200))


def brute_with_letters(value, ranks, letters):
    """Guess cost by trying every segment of every kind, letters by brute force priced by their pairs."""
    from functools import cache

    low_case, high_case = secrets._LETTERS, "".join(c.upper() for c in secrets._LETTERS if len(c.upper()) == 1 and c.upper() != c and c not in "ßÿ")
    by_letter, i = [secrets._char_cost(c) for c in value], 0
    while i < len(value):
        j = i + (value[i] in high_case)
        while j < len(value) and value[j] in low_case:
            j += 1
        if j - i < 4 + (value[i] in high_case):
            j = i
            while j < len(value) and value[j] in high_case:
                j += 1
        if j - i >= 4:
            for k in range(i, j):
                after = letters.get(value[k - 1].lower() if k > i else " ") or letters[""]
                by_letter[k] = min(by_letter[k], after.get(value[k].lower(), after[""]) + (math.log10(2) if value[k] in high_case else 0))
        i = max(j, i + 1) if j - i >= 4 else i + 1
    low, plain, step = value.lower(), value.lower().translate(secrets._LEET), math.log10(2)

    @cache
    def best(i):
        if i == len(value):
            return 0.0
        out = [by_letter[i] + best(i + 1)]
        for j in range(i + 3, len(value) + 1):
            if len(set(value[i:j])) == 1:
                out.append(secrets._char_cost(value[i]) + math.log10(j - i) + step + best(j))
            if all(x in secrets._NEXT for x in zip(low[i:j], low[i + 1 : j])):
                out.append(math.log10(40) + math.log10(j - i) + step + best(j))
            if low[i:j] in ranks:
                out.append(math.log10(ranks[low[i:j]] + 1) + (0 if value[i:j] == low[i:j] else step) + step + best(j))
            elif plain[i:j] in ranks:
                out.append(math.log10(ranks[plain[i:j]] + 1) + 3 * step + best(j))
        m = secrets._DATE.match(value, i, i + 10) if value[i].isdigit() else None
        if m:
            out.append(math.log10(365 * 100 if m.end() - i > 4 else 200) + step + best(m.end()))
        return min(out)

    return best(0)


def spoken(rng, n):
    """Random letters that can be spoken: consonants and vowels in turn, at times two."""
    out = ""
    while len(out) < n:
        out += rng.choice("bcdfghjklmnprstvwz") + rng.choice("aeiou") + (rng.choice("lnrst") if rng.random() < 0.3 else "")
    return out[:n]


def test_guess_cost_with_letter_pairs_is_the_least():
    rng, letters = random.Random(9), secrets.letter_costs()
    bits = ["password", "Wonderful", "aaaa", "2019-12-31", "x", "7", "p4ss", "!", "dragon", "321", "consistency", "ation", "qwerty", "ß", "É", "İ"]
    for k in range(300):
        v = "".join(rng.choice(bits) for _ in range(rng.randint(1, 4))) if k % 2 else spoken(rng, rng.randint(1, 14))
        cost, pieces = secrets.guess_cost(v, letters=letters)
        assert abs(cost - brute_with_letters(v, secrets._RANK, letters)) < 1e-9
        assert "".join(v[s:e] for _, s, e in pieces) == v and cost <= secrets.guess_cost(v)[0] + 1e-9


def test_passphrases_and_spoken_values_are_secrets_and_code_is_none(spark):
    rng = random.Random(5)
    words = ["correct", "horse", "battery", "staple", "monkey", "dragon", "window", "garden", "silver", "planet", "castle", "bridge", "rocket", "coffee", "summer", "purple"]
    phrases = ["".join(rng.sample(words, 5)) for _ in range(200)] + ["correcthorsebatterystaplemonkey"]
    said = [spoken(rng, n) for n in (16, 24, 40) for _ in range(100)]
    code = ['secret_key = os.environ.get("SECRET_KEY")', 'token = request.headers["X-Auth"]', "api_key=settings.API_KEY_PRODUCTION", "token is https://example.com/path/to/page", "password = getpass.getpass()", "token: config.auth.token"]
    texts = ["passphrase: " + x for x in phrases + said] + code
    got = [[s for s in r.spans if s.kind == "guess"] for r in sorted(secrets.scan(docs(spark, texts)).collect(), key=lambda r: r.doc_id)]
    n = len(phrases)
    assert all(got[:n]) and sum(map(bool, got[n : n + 300])) >= 285 and not any(got[n + 300 :])
    assert [r.text for r in secrets.redact(docs(spark, [texts[200], code[0]])).orderBy("doc_id").collect()] == ["passphrase: [SECRET]", code[0]]


def test_secrets_of_repeated_rows(spark):
    df = docs(spark, ["pwd: Xk9$mQ2!vLz8"] * 3).withColumn("doc_id", F.lit(1)).withColumn("kind", F.lit("clash"))
    rows = secrets.scan(df).collect()
    assert len(rows) == 3 and all([s.kind for s in r.spans] == ["guess"] for r in rows)


def test_words_of_the_documents_are_cheap(spark):
    prose = ["la consistency vertraulichkeit %d" % i for i in range(secrets.LEAST_DOCS)]
    copies = ["password: zyxkwvqjh"] * (2 * secrets.LEAST_DOCS)
    texts = ["the secret is consistency", "Token: Vertraulichkeit", "the secret is xkqzwvjhpl", *prose, *copies, "rare vocable", None]
    frame = docs(spark, texts)
    assert sorted(r.word for r in secrets.word_counts(frame).collect()) == ["consistency", "vertraulichkeit"]
    got = {r.doc_id: [s.kind for s in r.spans] for r in secrets.scan(frame).collect()}
    assert got[0] == [] and got[1] == ["assign"] and got[2] == ["guess"]
    masked = {r.doc_id: r.text for r in secrets.redact(frame).collect()}
    assert masked[0] == texts[0] and masked[2] == "the secret is [SECRET]"


def test_contexts_are_parts_of_names(spark):
    value = "p@ss!9xQ#22zz"
    names = ["AWS_SECRET_ACCESS_KEY=%s", 'SECRET_KEY = "%s"', "DB_PASSWORD=%s", 'dbPassword: "%s"', "spring.datasource.password=%s", "x-auth-token: %s", "secret_key_base: %s", "clientSecretId => %s", "password2 is %s", "bearer %s"]
    texts = [x % value for x in names] + ["redis://:s3cr3tXk9mQ2@host", f"db://{'u' * 100}:s3cr3tXk9mQ2@host", f"compass: {value}", f"secretary is {value}", "tokenize: " + value, "secret" + "1" * 5000]
    got = {r.doc_id: [texts[r.doc_id][s.start : s.end] for s in r.spans if s.kind == "guess"] for r in secrets.scan(docs(spark, texts)).collect()}
    for i in range(len(names)):
        assert got[i] == [value]
    assert got[len(names)] == got[len(names) + 1] == ["s3cr3tXk9mQ2"]
    assert not any(got[i] for i in range(len(names) + 2, len(texts)))


def test_all_words_count_and_rank_by_documents(spark):
    long = "x" * 40 + "yz"
    texts = [" ".join(w for w, n in (("alpha", 9), ("beta", 8), ("gamma", 8), (long, 6), ("omega", 5), ("rho", 4)) if i < n) for i in range(9)]
    assert {r.word: r["rank"] for r in secrets.dictionary(docs(spark, texts)).collect()} == {"alpha": 1, "beta": 3, "gamma": 3, long: 4, "omega": 5}
    got = secrets.scan(docs(spark, [*texts, f"the secret is {long}", "the secret is " + "xqz" * 7 + "w"])).orderBy("doc_id").collect()
    assert not got[9].spans and got[10].spans
    assert secrets.pair_counts(secrets.dictionary(docs(spark, texts)))["a", "l"] == 1


def test_guess_spans_and_masks(spark):
    texts = ["pwd: Xk9$mQ2!vLz8 here", "pwd: password123 here", "password is required for all", "db://me:s3cr3tXk9mQ2@host", None, "password=abcdefgh12345 and 0123456789abcdef0123456789abcdef"]
    got = {r.doc_id: [s.kind for s in r.spans] for r in secrets.scan(docs(spark, texts)).collect()}
    assert got[0] == ["guess"] and got[1] == [] and got[2] == [] and got[3] == ["guess"] and got[4] == []
    masked = {r.doc_id: r.text for r in secrets.redact(docs(spark, texts)).collect()}
    assert masked[0] == "pwd: [SECRET] here" and masked[4] is None and masked[5] == "[SECRET] and [SECRET]" and masked[2] == texts[2]


def test_license_base_phrases(spark):
    rng = random.Random(5)
    bits = ["under", "the", "mit", "license", "apache", "version", "2", "cc", "by", "nc", "x", "Éé", "MIT,", "LICENSE", "\n"]
    texts = [" ".join(rng.choice(bits) for _ in range(rng.randint(0, 60))) for _ in range(200)] + [None, "", "CC BY-NC 4.0", "under the MIT license " * 3000]
    got = {r.doc_id: r for r in licenses.scan(docs(spark, texts, base=1)).collect()}
    low = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    for i, t in enumerate(texts):
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(low))
        want = sorted((k, label) for p, label in licenses.PHRASES for k in range(len(w)) if w[k : k + len(p.split())] == p.split())
        assert got[i].n_words == len(w) and [(b.start, b.label) for b in got[i].base] == want
    assert licenses.scan(docs(spark, ["x"]).limit(0)).count() == 0


def test_matching_statistics():
    auto = licenses.TemplateAutomaton((("a", "x y z x y w"), ("b", "y z q x y z x"), ("c", "x y z x y w")), (("z x", "p"),))
    runs = {tuple(t[i:j]) for _, t in [*auto.templates, *((0, p) for p, _ in auto.phrases)] for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    rng = random.Random(1)
    for _ in range(100):
        tokens = [rng.randrange(len(auto.vocab)) for _ in range(20)]
        for i, (state, n) in enumerate(auto.statistics(tokens)):
            want = max((k for k in range(1, i + 2) if tuple(tokens[i + 1 - k : i + 1]) in runs), default=0)
            assert n == want
            if n:
                places = {(k, e) for k, (_, t) in enumerate(auto.templates) for e in range(len(t)) if e + 1 >= n and t[e + 1 - n : e + 1] == tokens[i + 1 - n : i + 1]}
                assert auto.ends[state] == places


def test_license_labels_of_broken_notices(spark):
    notice = licenses.TEMPLATES[1][1].split()
    broken = " ".join(notice[:30] + ["our"] + notice[30:])
    got = {r.doc_id: {m.label for m in r.matches} for r in licenses.scan(docs(spark, [broken, " ".join(notice[:12]), "This work is licensed under the GNU General Public License, version 3."])).collect()}
    assert got[0] == {"mit"} and got[1] == set() and got[2] == {"gpl-3"}


def test_license_labels_with_stray_matches(spark):
    notice = licenses.TEMPLATES[1][1].split()
    stray = "of the software blah persons to whom blah without limitation the blah".split()
    texts = []
    for n in (7, 8, 50):
        filler = (stray * n)[: min(3 * n, 60)]
        texts.append(" ".join(notice[:30] + filler + notice[30:]))
    texts.append(" ".join(notice[:30] + stray * 500 + notice[30:]))
    rest = " ".join(licenses.TEMPLATES[2][1].split()[65:])
    bsd = licenses._REDISTRIBUTION.replace("1 redis", "redis").replace("2 redis", "redis")
    texts += [bsd, f"{bsd} {licenses._ENDORSE[2:]}", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", f"{licenses.TEMPLATES[1][1]} {rest}", f"{bsd} and also {' '.join(notice)}", *[texts[0]] * 2]
    got = {r.doc_id: sorted({m.label for m in r.matches}) for r in licenses.scan(docs(spark, texts, matches="clash")).collect()}
    assert [got[i] for i in range(len(texts))] == [["mit"], ["mit"], ["mit"], [], ["bsd-2"], ["bsd-3"], ["cc-by-nc"], ["mit"], ["bsd-2", "mit"], ["mit"], ["mit"]]


def test_chains_equal_brute_force():
    rng = random.Random(2)

    def brute(found, length):
        best = []
        for i, (end, at, n) in enumerate(found):
            words = n
            for j in range(i):
                e, a, _ = found[j]
                over = max(0, e - (end - n), a - (at - n))
                if at > a and end - n - e <= length and over < n:
                    words = max(words, best[j] + n - over)
            best.append(words)
        return best

    for _ in range(200):
        length = rng.randint(3, 30)
        found = sorted((end, at, rng.randint(1, min(at, end))) for end, at in ((rng.randint(1, 200), rng.randint(1, length)) for _ in range(rng.randint(0, 60))))
        assert [c[3] for c in licenses._chained(found, length)] == brute(found, length)


def test_license_phrases_shorter_than_matches(spark):
    got = licenses.scan(docs(spark, ["x cc by nc y", "under the mit license"]), least=5).orderBy("doc_id").collect()
    assert [[b.label for b in r.base] for r in got] == [["cc-by-nc"], ["mit"]]


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body><header>Site</header><nav><ul><li><a href=1>A</a><li><a href=2>B</a></ul></nav>
<div class="ad">Buy</div><article><h1>Head &amp; more</h1><p><b>One   two.<br><p>Three &lt;x&gt; it&#39;s.</p><ul><li>i<li>j</ul></article><div class="comments"><p>Reader says</p></div><aside>s</aside><form>f</form><footer>&copy; z</footer></body></html>"""


def test_html_cases(spark):
    pages = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "plain & <b>bold"), (5, "u", "<p>a<p>b" + "<div>" * 5000), (6, "u", "<nav>x</nav>"), (7, "u", "<p>" + "long " * 50000), (7, "u", "<p>" + "long " * 50000)], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r.page_id: r for r in html_text.extract_pages(pages).collect()}
    assert got[1].text == "Head & more\n\nOne two.\n\nThree <x> it's.\n\ni\n\nj" and got[1].n_chars == len(got[1].text)
    assert got[2].text == "" and got[3].text == "" and got[4].text == "plain & bold" and got[5].text == "a\n\nb" and got[6].text == "" and got[7].n_chars == 249999
    assert html_text.extract_pages(pages.limit(0)).count() == 0


def test_html_by_density_alone():
    links = "".join(f'<a href="{i}">Link number {i}</a> ' for i in range(12))
    body = "".join(f"<p>Sentence number {i} of the story goes on and on for a good while here.</p>" for i in range(6))
    html = f"<body><div id=x>{links}</div><div id=y><h2>Story</h2>{body}</div><div id=z>{links}</div></body>"
    text = html_text.extract(html)
    assert text.startswith("Story\n\nSentence number 0") and "Link number" not in text and text.count("\n\n") == 6


def test_html_keeps_articles_in_doubtful_wrappers():
    story = "".join(f"<p>Sentence number {i} of the story goes on and on for a good while here.</p>" for i in range(6))
    want = "\n\n".join(f"Sentence number {i} of the story goes on and on for a good while here." for i in range(6))
    ad = '<div class="ad"><p>Buy this now, it is cheap.</p></div>'
    note = '<div id="cookie-notice"><form><p>We use cookies on this page.</p></form></div>'
    for start, end in (('<div class="layout has-sidebar">', "</div>"), ('<div id="content" class="with-comments">', "</div>"), ('<div class="post share-enabled">', "</div>"), ("<form action=x>", "</form>"), ("<form><fieldset>", "</fieldset></form>")):
        for inner, close in (("<article>", "</article>"), ("<main>", "</main>"), ("<div>", "</div>")):
            assert html_text.extract(f"<body>{note}{start}{inner}{story}{ad}{close}{ad}{end}{ad}</body>") == want
    replies = '<div class="comments">' + "<p>A long reply that is not the article at all, and goes on for long.</p>" * 30 + "</div>"
    assert html_text.extract(f"<body><article>{story}</article>{replies}</body>") == want


def test_html_keeps_what_only_looks_like_boilerplate():
    story = "".join(f"<p>Sentence number {i} of the story goes on and on for a good while here.</p>" for i in range(6))
    links = "".join(f'<li><a href="{i}">Reference number {i} of the article</a></li>' for i in range(3))
    kept = ['<p title="the hidden truth">X</p>', '<p><a href="x/hidden/">X</a></p>', "<p data-x='a hidden b'>X</p>", "<p title=\"see class='ad' there\">X</p>", '<section id="discussion"><p>X</p></section>', '<h2 id="search-results">X</h2>', '<p class="notice">X</p>', '<blockquote class="related">X</blockquote>']
    for x in kept:
        assert html_text.extract(f"<body><article>{story}{x}</article><footer>f</footer></body>").endswith("here.\n\nX"), x
    assert html_text.extract(f"<body><article>{story}<ul>{links}</ul></article></body>").endswith("Reference number 1 of the article\n\nReference number 2 of the article")
    for x in ('<div class="notice"><p>X</p></div>', '<div id="main-menu">X</div>', '<ul class="share-links"><li>X</ul>', "<form><p>X</p></form>", '<div class="adBox">X</div>', "<p hidden>X</p>"):
        assert html_text.extract(f"<body><article>{story}{x}</article></body>").endswith("here."), x
    replies = '<div class="comment-list">' + "<article class=comment><p>A long reply that is not the article at all, and goes on for long.</p></article>" * 30 + "</div>"
    assert html_text.extract(f"<body><article>{story}</article>{replies}</body>").endswith("here.")
    assert html_text.extract(f"<body><div><h1>Head</h1><div>{story}</div></div><p>Tiny.</p></body>").startswith("Head\n\nSentence")


def test_html_rows_and_broken_markup(spark):
    deep = "<b>" * 3000 + "<p>x" * 3000 + "</i>" * 3000
    rows = [(1, "u", "<p>a</p>"), (1, "u", "<p>a</p>"), (2, "u", deep), (3, None, "<header>" * 2000 + "y"), (None, "u", "<p>n</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("n_chars", F.lit("clash"))
    got = html_text.extract_pages(df).collect()
    assert len(got) == 5 and [r.text for r in got if r.page_id == 1] == ["a", "a"] and all(r.n_chars == len(r.text) for r in got)


def brute_selected(html):
    """The id of the selected node, straight from the definitions: all sums anew for each node, paths as lists."""
    from html.parser import HTMLParser
    from math import e, log

    nodes = []  # (id, tag, parent, own texts)

    class Reader(HTMLParser):
        open = [None]

        def handle_starttag(self, tag, attrs):
            nodes.append((dict(attrs).get("data-k"), tag, self.open[-1], []))
            self.open = [*self.open, len(nodes) - 1]

        def handle_endtag(self, tag):
            self.open = self.open[:-1]

        def handle_data(self, data):
            nodes[self.open[-1]][3].append(data)

    Reader().feed(html)
    up = lambda i: [i, *up(nodes[i][2])] if i is not None else []
    under = {i: [j for j in range(len(nodes)) if i in up(j)] for i in range(len(nodes))}
    size = lambda js: sum(len(" ".join(t.split())) for j in js for t in nodes[j][3])
    link = lambda i: [j for j in under[i] if any(nodes[x][1] == "a" for x in up(j) if x in under[i])]
    share = size(link(0)) / max(1, size(under[0]))

    def density(i):
        c, t, lc, lt = size(under[i]), max(1, len(under[i]) - 1), size(link(i)), sum(nodes[j][1] == "a" for j in under[i])
        if not c:
            return 0
        b = max(e, log(c / max(1, c - lc) * lc + share * c + e))
        return c / t * max(0, log(c / max(1, lc) * t / max(1, lt)) / log(b))

    kids = {i: [j for j in range(len(nodes)) if nodes[j][2] == i] for i in range(len(nodes))}
    d = {i: density(i) for i in range(len(nodes))}
    total = {i: sum(d[j] for j in kids[i]) if kids[i] else d[i] for i in d}
    top = lambda js: max(js, key=lambda i: (round(total[i], 6), -i))
    core = top(d)
    least = min(d[i] for i in up(core))
    marked = {core} | {top(under[i]) for i in d if all(d[j] >= least - 1e-9 and j != core for j in up(i))}
    common = [i for i in d if all(i in up(m) for m in marked)]
    return nodes[max(common, key=lambda i: len(up(i)))][0]


def test_html_selects_by_density():
    rng = random.Random(12)

    def tree(depth, count):
        out = []
        for _ in range(rng.randint(1, 4)):
            tag = rng.choice(["div", "div", "section", "span", "a"] if depth < 3 else ["span", "a"])
            if tag == "a" or depth > 3:
                inner = "w" * rng.randint(1, 60)
            else:
                inner = rng.choice(["", "text " * rng.randint(1, 40)]) + tree(depth + 1, count)
            count[0] += 1
            out.append(f'<{tag} data-k="{count[0]}">{inner}</{tag}>')
        return "".join(out)

    for _ in range(150):
        html = f'<body data-k="0">{tree(0, [0])}</body>'
        node = html_text.select(html_text.parse(html))
        opening = re.search(rf'data-k="{brute_selected(html)}"', html)
        assert opening and html_text_key(html, node) == brute_selected(html)


def html_text_key(html, node):
    """The key of a node: its place among all start tags in page order."""
    top = node
    while top.parent is not None:
        top = top.parent
    order = [x for x in html_text._walk(top) if x is not top]
    return re.findall(r'data-k="(\d+)"', html)[order.index(node)]


def license_labels(text):
    auto = licenses.TemplateAutomaton()
    words = [b"license" if w == b"licence" else w for w in licenses.words_of(text)]
    return sorted({c[0] for c in licenses.scan_words(auto, list(map(auto.vocab.get, words)))[1]})


def test_every_template_has_its_own_label_and_no_other():
    for label, text in licenses.TEMPLATES:
        assert license_labels(f"Some text. {text}. More text.") == [label], text
    assert license_labels("This library is free software under the GNU Lesser General Public License version 3") == ["lgpl"]
    assert license_labels("under the terms of the GNU General Public License version 3") == ["gpl-3"]
    assert license_labels("GNU General Public Licence version 2 as published by the Free Software Foundation") == ["gpl-2"]
    assert license_labels("licensed under the Apache License, Version 1.1") == []


def test_a_template_without_its_telling_words_has_no_wrong_label():
    for label, text in licenses.TEMPLATES:
        words = text.replace(".", " ").split()
        for telling in {w for w in words if w in licenses.TELLING}:
            found = license_labels(" ".join(w for w in words if w != telling))
            assert label not in found, (label, telling, found)
            family = {"affero": "gpl", "lesser": "gpl", "library": "gpl", "noncommercial": "cc-by", "sharealike": "cc-by", "noderivatives": "cc-by", "nc": "cc-by"}.get(telling)
            assert all(family and x.startswith(family) for x in found), (label, telling, found)


def test_a_british_spelling_is_no_base_phrase(spark):
    rows = licenses.scan(docs(spark, ["under the MIT licence", "under the MIT license", "under the MIT licence, and under the MIT license"])).orderBy("doc_id").collect()
    assert [[(b.start, b.label) for b in r.base] for r in rows] == [[], [(0, "mit")], [(5 - 1 + 1, "mit")]]
    twice = licenses.scan(docs(spark, ["under the MIT license"] * 2).withColumn("doc_id", F.lit(1))).collect()
    assert len(twice) == 2 and twice[0] == twice[1]


def test_comments_adverts_and_notices_go_wherever_they_are():
    said, post = "<p>" + "A reader says something that is rather long and goes on. " * 8 + "</p>", "<p>" + "Words of the article go on here, with many of them in a row. " * 3 + "</p>"
    inside = ['<section class="comments">%s</section>', '<div class="user-comments">%s</div>', '<div id="reader-comments">%s</div>', '<div class="google-ads">%s</div>', '<div class="sponsored-content">%s</div>', '<div class="cc-banner">%s</div>', '<article class="comment">%s</article>']
    inside += ['<p class="cookie-notice">A reader</p>', '<p class="advert">A reader</p>', '<p>x <span class="ad">A reader</span></p>']
    for part in inside:
        part = part % said if "%s" in part else part
        for page in ("<body><article>%s%s</article></body>", "<body><main>%s%s</main></body>", "<body><div class=post>%s</div>%s</body>"):
            text = html_text.extract(page % (post, part))
            assert "A reader" not in text and text.startswith("Words of the article"), (page, part)
    assert html_text.extract(f"<body><div class=post>{post}</div><div class='reader-comments'>{said * 3}</div></body>").startswith("Words")
    assert html_text.extract(f"<body><div class=c><p class=lead>Short lead.</p><div>{post * 4}</div></div></body>").startswith("Short lead.\n\nWords")
    assert html_text.extract(f"<body><div class=comments>{said}</div></body>") == ""
