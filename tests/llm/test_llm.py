"""The training-data operators against brute force, a library and planted cases."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from evidentia.llm import bpe, common, langid, licenses, linededup, merkle, mixing, quality, simhash, substring, tokencounts

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega"
TEXTS = [None, "", "   \n \t", LONG, LONG, LONG.replace("mu", "MU2"), "one two", "two one", "a\nb\na\n\nb", LONG + "\n" + LONG.replace("pi", "PI"), "z " * 500, "é ü 漢字 <|endoftext|> don't", "a b c d e\nb c d e f g"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en" if i % 2 else None, [None, "s", "t"][i % 3], len(t or "")) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def brute_fingerprint(text):
    w = [x for x in WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))]
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(fps):
    root = {i: i for i in fps}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in fps:
        for j in fps:
            if i < j and (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return {i: top(i) for i in fps}


def test_simhash_equals_brute_force(spark, odd):
    docs = odd.unionByName(common.documents(spark, SF).select(*odd.columns).withColumn("doc_id", F.col("doc_id") + 1000))
    fps = {r["doc_id"]: brute_fingerprint(r["text"]) for r in docs.collect()}
    want = brute_groups(fps)
    got = simhash.near_duplicates(docs).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {i: (f"{f:016x}", want[i]) for i, f in fps.items()}


def test_large_cells_lose_nothing(spark):
    rng = np.random.default_rng(1)
    base = int(rng.integers(0, 1 << 62))
    fps = sorted({base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 62, (60, 2))})
    nodes = spark.createDataFrame([(f,) for f in fps], "fp long")
    edges = common.linked_in_cells(simhash.grid_cells(nodes), simhash.near, "t", cap=8)
    got = {r["node"]: r["root"] for r in common.components(edges, "t").collect()}
    want = brute_groups({f: f for f in fps})
    assert {f: got.get(f, f) for f in fps} == want




@pytest.mark.parametrize("part", [200_000, 40])
def test_components_of_chains(spark, monkeypatch, part):
    monkeypatch.setattr(common, "PART", part)
    ids = np.random.default_rng(2).permutation(np.arange(-300, 300) * 10**15).tolist()
    chains = [ids[:250], ids[250:400], ids[400:]]
    edges = spark.createDataFrame([e for c in chains for e in zip(c, c[1:])] + [(ids[0], ids[0])], "a long, b long")
    got = {r["node"]: r["root"] for r in common.components(edges, "t").collect()}
    assert got == {i: min(c) for c in chains for i in c}


def test_lines_equal_brute_force(odd):
    # a line goes if any earlier one matches, so removed ones count as earlier too
    rows = [(r["doc_id"], r["text"]) for r in odd.orderBy("doc_id").collect()]
    seen, want = [], {}
    for k, t in rows:
        kept = []
        for line in (t or "").split("\n"):
            s = frozenset(WORDS.findall(line))
            gone = bool(s) and any(len(s & x) * 10 >= len(s | x) * 8 for x in seen)
            if s:
                seen.append(s)
            if not gone:
                kept.append(line)
        want[k] = None if t is None else "\n".join(kept)
    got = {r["doc_id"]: r["text"] for r in linededup.deduplicated(odd.withColumn("n_lines2", F.lit(1))).collect()}
    assert got == want


def test_bpe_equals_library(odd):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_path())
    got = {r["doc_id"]: r for r in bpe.token_digests(odd).collect()}
    for i, text in enumerate(TEXTS):
        ids = t.encode(text or "", add_special_tokens=False).ids
        back = t.decode(ids, skip_special_tokens=False)
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(back.encode()).hexdigest()
    trip = {r["doc_id"]: r["text"] for r in bpe.decode(bpe.encode(odd)).collect()}
    assert trip[3] == t.decode(t.encode(LONG, add_special_tokens=False).ids, skip_special_tokens=False)


def test_fingerprints(odd):
    got = {r["doc_id"]: r for r in merkle.with_successors(odd, ranges=3).collect()}
    assert set(got) == set(range(len(TEXTS)))
    for i, t in enumerate(TEXTS):
        t, n = t or "", TEXTS[i - 1] or ""
        edited = t[: len(t) - len(t) // 3] + n[: len(t) // 3]
        assert (got[i]["n_chars"], got[i]["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= got[i]["near_edited"] <= 1 and 0 <= got[i]["near_next"] <= 1
    assert got[3]["fingerprint"] == got[4]["fingerprint"] != got[5]["fingerprint"]
    assert got[4]["near_next"] == 1
    assert merkle.edits("a\nb\nc", "a\nx\nc") == [(1, 2)]
    assert merkle.edits("a", "a") == []


def test_mix_meets_targets(spark):
    docs = common.documents(spark, SF)
    rows = mixing.mix(docs).join(docs.select("doc_id", "source"), "doc_id").collect()
    by = {}
    for r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
        s = by.setdefault(r["source"], [0, r["target"], r["source_size"], 0])
        s[0] += r["taken"]
        s[3] = max(s[3], r["size"])
    for got, target, size, big in by.values():
        assert target <= 3 * size + 1e-6
        assert abs(got - target) <= max(0.05 * target, big / 2)
    again = mixing.mix(docs.repartition(7)).select("doc_id", "taken").collect()
    assert {r["doc_id"]: r["taken"] for r in again} == {r["doc_id"]: r["taken"] for r in rows}


def test_quality_counts(odd):
    got = {r["doc_id"]: r for r in quality.judge(odd, quality.Classifier()).collect()}
    for i, t in enumerate(TEXTS):
        w = WORDS.findall(t or "")
        grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        rep = {k + d for k, g in enumerate(grams) if grams.count(g) > 1 for d in range(3)}
        lines = [x for x in (t or "").split("\n") if WORDS.search(x)]
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(rep))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(rep) > 50 * len(w))


def test_quality_learns(spark):
    docs, labels = common.documents(spark, "/root/testdata/sf0.01"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality.judge(docs, quality.train(docs, labels)).join(labels, "doc_id").filter("not base_failed").collect()
    assert np.mean([r["kept"] == (r["quality"] == 1) for r in got]) > 0.9


def test_language_on_held_out_documents(spark, odd):
    docs = common.documents(spark, "/root/testdata/sf0.01")
    model = langid.train(docs)
    got = langid.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").filter(langid.held_out()).collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in got]) > 0.95
    assert np.mean([r["rejected"] for r in got]) < 0.02
    few = {r["doc_id"]: r["lang_pred"] for r in langid.identify(odd, model).collect()}
    assert few[0] == few[1] == few[2] == "und" and few[3] != "und"


def test_model_is_a_distribution():
    m = langid.Model.of_words({"x": langid.Counter({"abab": 3, "ba": 2, "bac": 1}), "y": langid.Counter({"cc": 1})})
    bits, n = m.bits(["abab", "cc"])
    assert bits[0].argmin() == 0 and bits[1].argmin() == 1 and n.tolist() == [5.0, 3.0]
    # behind any context the probabilities of all 4096 letters of the floor's alphabet and the end sum to 1
    for context in ("", "a", "ab", "aba", "zz", "az"):
        for j in range(2):
            total = 0.0
            for letter in "abc\x03":
                word = context + letter if letter != "\x03" else context
                grams, _, _ = langid._grams([word])
                at = len(context) + 1
                total += m.blocks[0].probabilities(grams)[at, j]
            grams, _, _ = langid._grams([context + "q"])
            total += (4096 - 4) * m.blocks[0].probabilities(grams)[len(context) + 1, j]
            assert abs(total - 1) < 0.01, (context, j, total)


def test_language_rejects_unknown_ones_and_learns_rare_ones(spark):
    docs = common.documents(spark, "/root/testdata/sf0.01")
    rare = spark.createDataFrame([(10**6 + i, f"hyvää päivää tämä on suomenkielinen lause numero {i} jossa on muutama sana", "fi", "s", 60) for i in range(6)], docs.schema)
    model = langid.train(docs.unionByName(rare))
    assert "fi" in model.langs
    odd = spark.createDataFrame([(1, "xqzjk vwpfg qqqzx jjkwv zzzxq hqzpf kvbxw qjzkx"), (1, "Ελληνικά κείμενα για δοκιμή του προγράμματος"), (None, "the of and to in is that was"), (2, "12 34"), (3, None)], "doc_id long, text string")
    got = [(r["lang_pred"], r["rejected"]) for r in langid.identify(odd, model).collect()]
    assert [x[1] for x in got] == [True, True, False, True, True] and [x[0] for x in got[3:]] == ["und", "und"]


def test_rollup_is_idempotent(spark, tmp_path):
    ledger = tokencounts.Ledger(spark, f"file://{tmp_path}/ledger")
    assert ledger.totals().collect() == []
    row = lambda *r: spark.createDataFrame([r], "source string, lang string, tokenizer_version string, tokens long")
    assert ledger.commit("1", inserted=row("a", "en", "v", 10).unionByName(row("b", None, "v", 3)))
    assert not ledger.commit("1", inserted=row("a", "en", "v", 10))
    rev = spark.createDataFrame([("a", "en", "v", 10, 12)], "source string, lang string, tokenizer_version string, old_tokens long, tokens long")
    assert ledger.commit("2", deleted=row("b", None, "v", 3), revised=rev)
    assert [tuple(r) for r in ledger.totals().collect()] == [("a", "en", "v", 1, 12)]
    # a batch without its mark doesn't count and can be committed again
    mark = sorted((tmp_path / "ledger/marks").glob("0*"))[-1]
    mark.unlink()
    (mark.parent / f".{mark.name}.crc").unlink(missing_ok=True)
    assert sorted(map(tuple, ledger.totals().collect()), key=str) == [("a", "en", "v", 1, 10), ("b", None, "v", 1, 3)]
    assert ledger.commit("2", deleted=row("b", None, "v", 3), revised=rev)
    assert [tuple(r) for r in ledger.totals().collect()] == [("a", "en", "v", 1, 12)]
    # what a writer that died before it claimed its mark left aside doesn't count
    (mark.parent / "_lost").write_text("")
    assert [tuple(r) for r in ledger.totals().collect()] == [("a", "en", "v", 1, 12)]
    # a second writer that starts from the same totals loses the mark and starts again
    other = tokencounts.Ledger(spark, f"file://{tmp_path}/ledger")
    stale = other.batches()
    assert ledger.commit("3", inserted=row("c", None, "v", None))
    real, seen = other.batches, iter([stale])
    other.batches = lambda *a: next(seen, None) or real()
    assert other.commit("4", inserted=row("a", "en", "v", 1))
    assert sorted(map(tuple, ledger.totals().collect()), key=str) == [("a", "en", "v", 2, 13), ("c", None, "v", 1, 0)]
    for bad in ("", "../x", "a/b"):
        with pytest.raises(ValueError):
            ledger.commit(bad, inserted=row("a", "en", "v", 1))


def test_token_counts_equal_a_recount(spark):
    import duckdb

    from evidentia.llm import queries

    sf = "/root/testdata/sf0.001"
    got = sorted(map(tuple, queries.op6_token_counts(spark, sf).collect()), key=str)
    sql = r"SELECT source, lang, 'words-1', count(*), CAST(sum(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))) AS BIGINT) FROM '{}/documents.parquet' GROUP BY ALL".format(sf)
    assert [r for r in got if r[2] == "words-1"] == sorted(duckdb.sql(sql).fetchall(), key=str)
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_path())
    want: dict = {}
    for r in common.documents(spark, sf).collect():
        x = want.setdefault((r["source"], r["lang"]), [0, 0])
        x[0] += 1
        x[1] += len(t.encode(r["text"] or "", add_special_tokens=False).ids)
    assert {(r[0], r[1]): [r[3], r[4]] for r in got if r[2] != "words-1"} == want


@pytest.fixture(scope="module")
def unknown(spark):
    return licenses.sample(common.documents(spark, "/root/testdata/sf0.01"))


def test_licences(spark, unknown):
    docs = spark.createDataFrame([(1, "x\nReleased under the MIT License."), (2, "the license plate was lost"), (3, None), (4, "Licensed under the Apache License, Version 2.0."), (5, "")], "doc_id long, text string")
    got = {(r["doc_id"], r["line"]): (r["family"], r["confirmed"]) for r in licenses.scan(docs, model=licenses.train(unknown)).collect()}
    assert got == {(1, 1): ("mit", True), (4, 0): ("apache-2.0", True), (2, 0): ("unknown", False)}


def test_licenses_inside_longer_and_wrapped_lines(spark, unknown):
    other = lambda n: " ".join("wort%d" % i for i in range(n))
    notices = [(f, t) for f, ts in licenses.TEMPLATES.items() for t in ts]
    rows = [(100 * k + n // 10, f"{other(n)} {t} {other(n // 2)}") for k, (_, t) in enumerate(notices) for n in (0, 20, 40, 200)]
    for k, (_, t) in enumerate(notices):
        w = t.split()
        rows.append((100 * k + 50, "a b c\n" + " ".join(w[: len(w) // 2]) + "\n" + " ".join(w[len(w) // 2 :]) + "\nend of it"))
    got = {}
    for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), model=licenses.train(unknown)).collect():
        if r["confirmed"] and r["overlap"] == 1:
            got.setdefault(r["doc_id"], r["family"])
    assert got == {i: notices[i // 100][0] for i, _ in rows}


def test_licenses_left_out_rows(unknown):
    half = unknown[::2]
    m, rows = licenses.train(half), licenses.labelled(list(unknown[1::2]), seed=7)
    p = m.probabilities([" ".join(w) for _, w in rows])
    best = [m.families[i] if x >= 0.5 else "" for i, x in zip(p.argmax(axis=1), p.max(axis=1))]
    right = np.array([f == b for (f, _), b in zip(rows, best)])
    is_notice = np.array([f != "" for f, _ in rows])
    said = np.array([b != "" for b in best])
    assert right[is_notice].mean() > 0.9 and (right & said)[said].mean() > 0.9
    # calibrated: of paragraphs with a probability of about x, about x are notices of the family
    y = np.array([[f == c for c in m.families] for f, _ in rows])
    assert abs(p[p > 0.5].mean() - y[p > 0.5].mean()) < 0.1


def test_telling_words_lose_no_notice(unknown):
    m = licenses.train(unknown)
    telling = set(licenses.telling(m, unknown))
    rows = licenses.labelled(list(unknown), seed=3)
    p = m.probabilities([" ".join(w) for _, w in rows]).max(axis=1)
    assert all(telling & set(w) for (_, w), x in zip(rows, p) if x >= 0.5)
    assert all(telling & set(licenses._words_of(t)) for ts in licenses.TEMPLATES.values() for t in ts)


def test_licenses_of_repeated_and_null_keys(spark, unknown):
    rows = [(k, t) for k in (1, None) for t in ("Released under the MIT License.", "Licensed under the GPL.", "Licensed under the GPL.")]
    got = sorted((r["doc_id"] or 0, r["family"]) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), model=licenses.train(unknown)).collect())
    assert got == [(k, f) for k in (0, 1) for f in ("gpl", "gpl", "mit")]


def test_repeated_passages(spark):
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    text = lambda n: " ".join(word() for _ in range(n))
    p = text(90)
    rows = [(1, text(60) + "\n" + p), (2, text(40) + " " + p + " " + text(33)), (3, text(200)), (4, None), (5, p.replace(p.split()[40], "changed"))]
    got = substring.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in got} == {1, 2, 5}
    assert {r["keeper_doc_id"] for r in got} == {1}
    assert next(r for r in got if r["doc_id"] == 1)["n_removed_words"] == 0


def test_runs_that_start_mid_line(spark):
    rng = np.random.default_rng(4)
    text = lambda n: " ".join("w%d" % x for x in rng.integers(0, 10**9, n))
    rows = []
    for i in range(120):
        p = text(51 + i % 10)
        rows += [(2 * i, f"{text(20 + i % 7)} {p} {text(30)}"), (2 * i + 1, f"{text(33)} {p.replace(' ', chr(10), i % 3)} {text(21 + i % 5)}")]
    rows += [(1000, "z " * 51), (1001, text(400)), (1002, text(49))]
    at: dict = {}  # brute force: every run of 50 words and its places
    for k, t in rows:
        w = t.split()
        for j in range(len(w) - 49):
            at.setdefault(" ".join(w[j : j + 50]), []).append((k, j))
    want: dict = {}
    for places in at.values():
        for k, j in places if len(places) > 1 else []:
            want.setdefault((k, places[0][0]), set()).update(range(j, j + 50))
    got = {(r["doc_id"], r["keeper_doc_id"]): r for r in substring.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) == set(want) and len(want) == 241
    assert all(got[k]["n_words"] >= len(v) for k, v in want.items())
    assert all(got[k]["n_removed_words"] == (0 if k[0] == k[1] else got[k]["n_words"]) for k in want if k[0] != 1000)
    assert (got[1000, 1000]["n_words"], got[1000, 1000]["n_removed_words"]) == (51, 1)


def test_short_repeats_have_rows(spark):
    rng = np.random.default_rng(5)
    text = lambda n: " ".join("w%d" % x for x in rng.integers(0, 10**9, n))
    verse = [text(4) for _ in range(9)]
    a, b, c = text(5), text(12), text(15)
    rows = [(1, "\n".join(verse)), (2, text(9) + "\n" + "\n".join(verse)), (3, a + "\n" + text(7)), (4, b), (5, c), (6, text(8)), (7, "\n".join([a, b, c, text(6)]))]
    got = {(r["doc_id"], r["keeper_doc_id"]): (r["n_paragraphs"], r["n_words"], r["n_removed_words"]) for r in substring.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    kept = {(1, 1): (9, 36, 0), (3, 3): (1, 5, 0), (4, 4): (1, 12, 0), (5, 5): (1, 15, 0)}
    assert got == kept | {(2, 1): (9, 36, 36), (7, 3): (1, 5, 5), (7, 4): (1, 12, 12), (7, 5): (1, 15, 15)}


def test_empty_tables(spark, empty):
    assert simhash.near_duplicates(empty).count() == 0
    assert linededup.deduplicated(empty).count() == 0
    assert bpe.encode(empty).count() == 0
    assert merkle.with_successors(empty, ranges=2).count() == 0
    assert mixing.mix(empty).count() == 0
    assert langid.identify(empty, langid.train(empty)).count() == 0
    assert substring.passages(empty).count() == 0
    assert licenses.scan(empty).count() == 0
    assert quality.judge(empty, quality.Classifier()).count() == 0


def test_pipeline_keeps_clean_documents(spark):
    import corpus_pipeline

    docs = common.documents(spark, SF)
    for name, stage in corpus_pipeline.STAGES:
        out = common.saved(stage(spark, docs, SF), f"t-{name}")
        if name != "tokens":
            assert out.columns == docs.columns, name
        if name in ("language", "lines", "near_copies"):
            assert out.select("doc_id").distinct().count() == out.count() >= 0.5 * docs.count()
        docs = out
    assert docs.filter("n_tokens > 0").count() > 0


REPEATED = [(1, LONG), (1, LONG.replace("mu", "MU2")), (1, "own line of this row\nshared by two"), (1, "unique line of this row\nshared by two"), (None, "first without key\nshared by two"), (None, "second without key"), (2, LONG), (2, LONG), (3, None), (4, "")]


@pytest.fixture(scope="module")
def repeated(spark):
    """Rows with repeated and null keys, equal rows, and columns whose names operators use themselves."""
    rows = [(k, t, "en", "s" if i % 2 else None, i, 7, "x") for i, (k, t) in enumerate(REPEATED)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_lines int, doc int, `a.b` string")


def test_lines_of_repeated_and_null_keys(repeated):
    out = linededup.deduplicated(repeated)
    assert out.columns == [*repeated.columns, "n_lines_", "n_removed", "n_near"]
    got = sorted(((r["n_lines"], r["text"]) for r in out.collect()))
    texts = dict(got)
    # null keys come first, then keys in order; of rows of one key the order is that of the texts' hashes
    assert texts[4] == "first without key\nshared by two" and texts[5] == "second without key"
    assert texts[2] == "own line of this row" and texts[3] == "unique line of this row"
    assert sorted([texts[0], texts[1]]) == ["", max(LONG, LONG.replace("mu", "MU2"), key=lambda t: t == (texts[0] or texts[1]))]
    assert texts[6] == texts[7] == "" and texts[8] is None and texts[9] == ""
    kept = linededup.without_repeats(repeated)
    assert kept.columns == repeated.columns and sorted(r["n_lines"] for r in kept.collect() if r["n_lines"] not in (0, 1)) == [2, 3, 4, 5, 8, 9]


def test_keep_one_of_repeated_and_null_keys(spark, repeated):
    got = {r["n_lines"] for r in simhash.keep_one(repeated).collect()}
    # one changed word of 24 is more than three bits: row 1 is a text of its own
    assert {1, 2, 3, 4, 5} <= got and len(got & {0, 6, 7}) == 1 and len(got & {8, 9}) == 1
    assert simhash.keep_one(repeated).columns == repeated.columns
    u = [(2, "one two three four"), (5, "one two three four"), (5, "another text stands here alone"), (None, "no key but text of its own"), (None, "no key and yet another text"), (None, "no key but text of its own")]
    d = spark.createDataFrame(u, "doc_id long, text string")
    kept = sorted(map(tuple, simhash.keep_one(d).collect()), key=str)
    assert kept == sorted([u[0], u[2], u[3], u[4]], key=str)


def test_mix_of_repeated_and_null_keys(spark):
    w = lambda n: " ".join(["w"] * n)
    d = spark.createDataFrame([(1, w(400), None), (1, w(40), None), (None, w(30), "a"), (None, w(300), "a"), (2, None, "a"), (3, w(50), "b"), (3, w(50), "b")], "doc_id long, text string, source string")
    mix = mixing.mix(d).collect()
    assert len(mix) == 7 and all(r["taken"] == r["copies"] * r["size"] for r in mix)
    want = sorted(r["size"] for r in mix for _ in range(r["copies"]))
    assert sorted(len(r["text"].split()) for r in mixing.mixed(d).collect()) == want
    assert mixing.mixed(d.withColumn("copies", F.lit(1)).withColumn("s", F.lit("x"))).columns == ["doc_id", "text", "source", "copies", "s"]


def brute_order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))


def test_fingerprints_of_any_keys(spark):
    texts = ["first text. it has a line\nand another", "second text", "third one\nwith lines\nthree", ""]
    for keys, kind in (([None] * 4, "long"), (["a", "b", None, "c"], "string"), ([5, 5, 5, 1], "long"), ([3], "int")):
        rows = list(zip(keys, texts))
        got = merkle.with_successors(spark.createDataFrame(rows, f"doc_id {kind}, text string"), ranges=3).collect()
        assert len(got) == len(rows)
        assert sorted((str(r["doc_id"]), r["n_chars"]) for r in got) == sorted((str(k), len(t)) for k, t in rows)
        # each row's edited text ends with the start of some row's text, and each row follows one other
        edited = lambda t, n: hashlib.sha256((t[: len(t) - len(t) // 3] + n[: len(t) // 3]).encode()).hexdigest()
        for r in got:
            assert r["edited_sha256"] in {edited(t, n) for k, t in rows if len(t) == r["n_chars"] for _, n in rows}
    keyed = [(4 - i, t) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r for r in merkle.with_successors(spark.createDataFrame(keyed, "doc_id int, text string"), ranges=2).collect()}
    for i, (k, t) in enumerate(keyed):
        n = keyed[(i + 1) % 4][1]
        assert got[k]["edited_sha256"] == hashlib.sha256((t[: len(t) - len(t) // 3] + n[: len(t) // 3]).encode()).hexdigest()
        assert got[k]["fingerprint"] == merkle.fingerprint(t)


def test_tree_and_likeness_equal_brute_force():
    rng = np.random.default_rng(8)
    text = "\n".join(" ".join("w%d" % x for x in rng.integers(0, 10**6, int(n))) for n in rng.integers(1, 60, 40))
    lines = text.split("\n")
    changed = lines[:5] + ["new line"] + lines[5:20] + [lines[20].replace("w", "v", 1)] + lines[21:33] + lines[34:]
    other = "\n".join(changed)
    a, b = merkle.tree(text), merkle.tree(other)
    leaves = lambda t: [x for s in t["sections"] for p in s["paragraphs"] for x in p["leaves"]]
    from collections import Counter

    p, q = Counter(leaves(a)), Counter(leaves(b))
    near, where = merkle.compared(a, b)
    assert near == pytest.approx((p & q).total() / (p | q).total(), abs=1e-12)
    assert where == [(20, 21), (33, 34)] and merkle.compared(b, a)[1] == [(5, 6), (21, 22)]
    assert merkle.likeness(merkle.written(a), merkle.written(b)) == near and merkle.read(merkle.written(a))["root"] == a["root"]
    assert sum(len(p["leaves"]) for s in a["sections"] for p in s["paragraphs"]) > 64
    # pieces are cut alike wherever they stand, with and without spaces
    solid = "".join(chr(0x4E00 + x) for x in rng.integers(0, 5000, 3000))
    assert merkle.compared(merkle.tree(solid), merkle.tree("x" + solid))[0] > 0.9


def test_passages_of_repeated_and_null_keys(spark):
    rng = np.random.default_rng(9)
    text = lambda n: " ".join("w%d" % x for x in rng.integers(0, 10**9, n))
    p, q = text(12), text(15)  # too short to be cut
    rows = [(1, p + "\n" + text(9)), (1, p + "\n" + text(8)), (None, q + "\n" + text(7)), (5, q), (6, text(30)), (6, None), (7, ""), (8, p), (8, p)]
    got = {(r["doc_id"], r["keeper_doc_id"]): (r["n_paragraphs"], r["n_words"], r["n_removed_words"]) for r in substring.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 1): (2, 24, 12), (8, 1): (1, 12, 12), (5, 5): (1, 15, 0), (None, 5): (1, 15, 15)}


def test_quality_on_rows_left_out(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = common.documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet")
    out = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    model = quality.train(docs, labels.filter(~out))
    got = quality.judge(docs, model).join(labels.filter(out), "doc_id").filter("not base_failed").collect()
    assert len(got) > 50 and np.mean([r["kept"] == (r["quality"] == 1) for r in got]) > 0.9


def test_quality_counts_equal_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    sql = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM '{}/documents.parquet')
    SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
    (SELECT count(*) - count(DISTINCT x) FROM unnest(string_split(t, chr(10))) AS l(x) WHERE regexp_matches(x, '[^\x20\x09-\x0D]')) AS n_dup_lines FROM d""".format(sf)
    want = {r[0]: tuple(map(int, r[1:])) for r in duckdb.sql(sql).fetchall()}
    got = {r["doc_id"]: (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"]) for r in quality.judge(common.documents(spark, sf), quality.Classifier()).collect()}
    assert got == want


def test_pipeline_of_odd_tables(spark, odd, empty):
    import corpus_pipeline

    for docs in (empty, odd.withColumn("n_lines", F.lit(1)).withColumn("copies", F.lit(2)).withColumn("row", F.lit("x")).withColumn("a.b", F.lit(3))):
        for name, stage in corpus_pipeline.STAGES:
            out = common.saved(stage(spark, docs, SF), f"t-{name}")
            if name != "tokens":
                assert out.columns == docs.columns, name
            docs = out


def test_candidates_are_few_and_lose_no_match(spark):
    # long lines that share a rare word and nothing else, and near copies with 0.75 to 0.9 of their words in common
    rng = np.random.default_rng(8)
    words = [[f"w{x}" for x in rng.choice(20_000, 130, replace=False)] + [f"rare{k % 5}"] for k in range(60)]
    for k in range(40):
        base = list(words[k % 8])
        for at in rng.choice(len(base), 5 + k % 16, replace=False):
            base[at] = f"n{k}-{at}"
        words.append(base)
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(words)], "doc_id long, text string")
    classes = linededup.token_classes(docs, linededup.token_levels(docs)).cache()
    sets = [frozenset(w) for w in words]
    near = {(a, b) for b in range(len(sets)) for a in range(b) if len(sets[a] & sets[b]) * 10 >= len(sets[a] | sets[b]) * 8}
    of = {r["id"]: r["doc"] for r in classes.collect()}
    found = {(of[r["a"]], of[r["b"]]) for r in linededup.candidates(classes, spark.createDataFrame([], "a long, b long")).collect()}
    assert near and near <= found
    assert all(len(sets[a] & sets[b]) * 10 >= len(sets[a] | sets[b]) * 4 for a, b in found)
    gone = {r["doc_id"] for r in linededup.deduplicated(docs).collect() if r["n_near"]}
    assert gone == {b for _, b in near}
    classes.unpersist()


def test_repeated_runs_are_stretches(spark):
    rng = np.random.default_rng(9)
    w = [f"w{x}" for x in rng.integers(0, 5_000, 900)]
    texts = [w, w, w[100:400], [f"x{k}" for k in range(40)] + w[350:700] + w[120:260], ["z"] * 130, ["y", *["z"] * 70], w[:300] + ["q"] + w[301:], [f"v{k}" for k in range(90)]]
    docs = spark.createDataFrame([(None if k == 6 else k, " ".join(x)) for k, x in enumerate(texts)] + [(1, " ".join(w))], "doc_id long, text string")
    got = substring.repeated_runs(docs, common.saved(substring.parts(docs, "doc_id", "text"), "t")).collect()
    places = {}
    for k in sorted(range(len(texts))):
        for i in range(len(texts[k]) - substring.RUN + 1):
            places.setdefault(tuple(texts[k][i : i + substring.RUN]), []).append((9 if k == 6 else k, i))
    want = {(k, i): (min(p)[0], (k, i) == min(p)) for p in places.values() if len(p) > 1 for k, i in p}
    number = lambda k: 9 if k is None else k
    spelled = [((number(r["doc"]), i), (number(r["keeper"]), r["first"])) for r in got for i in range(r["start"], r["start"] + r["size"] - substring.RUN + 1)]
    assert len(spelled) == len(want) and dict(spelled) == want
    assert len(got) * 4 < len(want)


def test_workers_hold_small_batches_and_blocks(spark, monkeypatch):
    docs = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)
    seen = []
    counts = common.in_batches(docs).mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["doc_id"]) for b in batches), "doc_id long")
    assert max(r["doc_id"] for r in counts.collect()) <= common.BATCH_ROWS
    model = langid.Model.of_words({"a": {"abc": 3, "bcd": 1}, "b": {"xyz": 2}})
    words = ["abc", "xyz", "ab", "q", "bcdx", "é", "abcabc"]
    whole = model.bits(words)
    plain = langid.Model._bits
    monkeypatch.setattr(langid.Model, "_bits", lambda m, w: (seen.append(len(w)), plain(m, w))[1])
    monkeypatch.setattr(langid, "SCORED", 2)
    parts = model.bits(words)
    assert max(seen) == 2 and all(np.array_equal(a, b) for a, b in zip(whole, parts))


def test_paragraph_sets_are_read_once_and_leads_are_not_compared_again(spark, monkeypatch):
    met = spark.createDataFrame([(1, 10, 1), (2, 10, 1), (1, 11, 1), (2, 11, 1), (3, 11, 1), (4, 12, 4), (5, 12, 4), (6, 12, 4)], "h long, value long, lead long")
    near = spark.createDataFrame([(1, 3), (4, 5), (4, 6)], "a long, b long")
    # a bucket of two holds nothing untold, one whose others are all linked neither
    assert {(r["value"], r["h"]) for r in substring.left_open(met, near).collect()} == {(11, 2), (11, 3)}
    rng = np.random.default_rng(4)
    at, size = np.array([0, 9, 40]), np.array([9, 31, 5])
    words = rng.integers(0, 3, 60).astype(np.uint64)
    n, flat = substring.distinct_shingles(words, at, size)
    want = [np.unique(substring.shingles(words[a : a + s])) for a, s in zip(at, size)]
    assert n.tolist() == [len(x) for x in want] and np.array_equal(flat, np.concatenate(want))
    calls, plain = [], substring._sets
    monkeypatch.setattr(substring, "_sets", lambda *a: (calls.append(1), plain(*a))[1])
    base = [f"w{x}" for x in rng.integers(0, 10_000, 60)]
    rows = [(k, " ".join(base[:k] + ["new"] + base[k + 1 :])) for k in range(0, 60, 20)] + [(99, " ".join(f"u{x}" for x in range(60)))]
    got = substring.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(calls) == 1 and {r["doc_id"] for r in got} == {0, 20, 40}


def test_words_of_lines_are_found_without_regular_expressions_over_whole_texts(spark):
    lines = ["a b", " a  b", "a\tb", "a\x0bb c", "a\x0cb", "a\rb\r", "", " ", "a\x85b\u2003c \x1cd", "é 漢 字"]
    df = spark.createDataFrame([(x,) for x in lines], "text string")
    assert [r[0] for r in df.select(linededup._words(F.col("text"))).collect()] == [WORDS.findall(x) for x in lines]
    counts = linededup.token_levels(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" not in counts and "RLIKE" not in df.select(linededup._words(F.col("text")))._jdf.queryExecution().optimizedPlan().toString()
    # both halves of the sketches' difference are told from all and the marked
    rng = np.random.default_rng(2)
    sets = [rng.integers(-(1 << 62), 1 << 62, 90).tolist() for _ in range(2)]
    rows = spark.createDataFrame([(x,) for x in sets], "t array<long>").select(linededup._sketch(F.col("t"), False), linededup._sketch(F.col("t"), True)).collect()
    every, marked = ((rows[0][k] ^ rows[1][k]) % (1 << 64) for k in range(2))
    bits = np.bincount([h % 128 for h in sets[0] + sets[1]], minlength=128) % 2
    assert marked.bit_count() + (every ^ marked).bit_count() == bits.sum()


def test_words_are_hashed_side_by_side(monkeypatch):
    texts = [None, "", " \t ", "a\x0bb  c\r\n\n \n" + " ".join("é" * k for k in range(1, 40)), "no end", "\n".join("xyz"[: k % 4] * (k // 3) + "\x85\xa0" for k in range(120)), "\udc80 x"]
    asked = []
    real = substring.xxhash.xxh64_intdigest
    monkeypatch.setattr(substring.xxhash, "xxh64_intdigest", lambda w, seed: asked.append(w) or real(w, seed))
    h, line, text = substring.Cutter().read(texts)
    lines = [(k, x.split()) for k, t in enumerate(texts) for x in (t or "").encode("utf-8", "surrogatepass").split(b"\n") if x.split()]
    assert h.tolist() == [real(w, 5) for _, ws in lines for w in ws]
    assert line.tolist() == [i for i, (_, ws) in enumerate(lines) for _ in ws] and text.tolist() == [k for k, ws in lines for _ in ws]
    # before, the library was asked for every new word
    assert asked and min(map(len, asked)) >= 32
    for span in (1, 2, 24, 25, 33):
        x = np.random.default_rng(span).integers(0, 1 << 62, 100, dtype=np.uint64)
        assert substring._over(np.minimum, x, span).tolist() == [x[i : i + span].min() for i in range(101 - span)]
    assert not len(substring.Cutter().read([None, " "])[0])


def test_lines_are_numbered_only_where_some_go(spark):
    docs = spark.createDataFrame([(1, "one two three\n\n \nfour five"), (2, "one two three\n\nown line here\n \n"), (3, "four five"), (4, None), (5, " \n")], "doc_id long, text string")
    out = linededup.deduplicated(docs)
    rows = {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in out.collect()}
    assert rows == {1: ("one two three\n\n \nfour five", 2, 0), 2: ("\nown line here\n \n", 2, 1), 3: ("", 1, 1), 4: (None, 0, 0), 5: (" \n", 0, 0)}
    # before, each line of every text was given its number by a transform
    assert "transform(split(" not in out._jdf.queryExecution().optimizedPlan().toString()
