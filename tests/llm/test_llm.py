"""The training-data operators against brute-force versions on small tables with nulls, ties, repeats and empty texts."""

import base64
import hashlib
import random
import re
import time
import tracemalloc
import weakref
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.llm import decontaminate, jaccard_join, license_scan, packing, quality, substring_dedup, suffix_dedup, toxicity, url_filter, warc
from lattica.llm.words import ALNUM, NON_BLANK, Words, minimiser_at

BLANK = r"[^\x20\x09-\x0D]+"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, removed int, label string"


def prose(rng, n):
    return [rng.choice(["the", "of", "Ann", "é", "b,", "run", "x1", "zu", "kö", "far."]) + str(rng.randrange(40)) for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    base = prose(rng, 120)
    passage = prose(rng, 60)
    out = [(0, " ".join(base)), (1, " ".join(base)), (2, " ".join(base[:115] + ["new", "end"])), (3, None), (4, ""), (5, " \n\t "), (6, "one two"), (7, "One  two")]
    out += [(8, " ".join(prose(rng, 50) + passage + prose(rng, 30))), (9, "\n".join(prose(rng, 70)) + "\n" + " ".join(passage)), (10, " ".join(["a"] * 200)), (None, " ".join(prose(rng, 90)))]
    out += [(k, " ".join(prose(rng, rng.randrange(1, 150)))) for k in range(11, 40)]
    out.append(out[20])  # a repeated row
    return [(i, t, None if k % 7 == 0 else "en", "s", len(t or ""), "n", k, "l") for k, (i, t) in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def split(text, pattern=BLANK):
    return re.findall(pattern, text or "")


def test_words_and_minimisers():
    texts = [b"The  cat\nsat", b"", "é a".encode()]
    w = Words(texts, NON_BLANK)
    assert [w.words(i) for i in range(3)] == [re.findall(rb"[^\x20\x09-\x0D]+", t) for t in texts]
    g = np.random.default_rng(0).integers(0, 9, 80).astype(np.uint64)
    assert all(p == i + np.argmin(g[i : i + 7]) for i, p in enumerate(minimiser_at(g, 7)))
    assert Words([b"A,b"], ALNUM, lower=True).words(0) == [b"a", b"b"]


def test_repeated_windows(docs, rows, nothing):
    n = 35
    seen = Counter(tuple(split(t)[i : i + n]) for _, t, *_ in rows for i in range(len(split(t)) - n + 1))
    want = []
    for i, t, *_ in rows:
        w, gone = split(t), set()
        for k in range(len(w) - n + 1):
            if seen[tuple(w[k : k + n])] > 1:
                gone |= set(range(k, k + n))
        want.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    got = [tuple(r) for r in substring_dedup.remove_repeated(docs, cells=1 << 20).select("doc_id", "n_words", "n_removed", "kept_text").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert substring_dedup.remove_repeated(nothing, cells=1 << 20).count() == 0


def test_suffix_passages(docs, rows, nothing):
    n = 50
    first, count = {}, Counter()
    for i, t, *_ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        w = split(t)
        for k in range(len(w) - n + 1):
            g = tuple(w[k : k + n])
            count[g] += 1
            first.setdefault(g, (i, k))
    want = set()
    for i, t, *_ in rows:
        w = split(t)
        cover = [any(count[tuple(w[k : k + n])] > 1 for k in range(max(0, p - n + 1), min(p, len(w) - n) + 1)) for p in range(len(w))]
        p = 0
        while p < len(w):
            q = p
            while q < len(w) and cover[q]:
                q += 1
            if q > p:
                want.add((i, p, q - p))
            p = max(q, p + 1)
    got = {tuple(r)[:3] for r in suffix_dedup.spans(suffix_dedup.passages(docs, cells=1 << 20)).collect()}
    assert got == want
    kept = {r["doc_id"]: r for r in suffix_dedup.without_repeats(docs).collect()}
    assert kept[0]["text"] == rows[0][1] and split(kept[1]["text"]) == [] and kept[3]["text"] is None
    assert split(kept[9]["text"]) == split(rows[9][1])[:70] and kept[9]["n_chars"] == len(kept[9]["text"])
    assert suffix_dedup.without_repeats(nothing).count() == 0


def test_jaccard_components(docs, rows, nothing):
    sets = []
    for _, t, *_ in rows:
        w = split((t or "").translate(LOWER))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    comp = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                comp = [comp[b] if c == comp[a] else c for c in comp]
    least = {c: min((rows[k][0] for k in range(len(rows)) if comp[k] == c and rows[k][0] is not None), default=None) for c in comp}
    want = sorted(((r[0], len(s), least[c]) for r, s, c in zip(rows, sets, comp, strict=True)), key=str)
    got = sorted((tuple(r) for r in jaccard_join.linked(docs).select("doc_id", "n_shingles", "component_id").collect()), key=str)
    assert got == want
    left = jaccard_join.one_of_each(docs)
    assert left.columns == docs.columns
    assert {r["doc_id"] for r in left.collect()} == {r[0] for r in rows} - {1, 2, 7}
    assert jaccard_join.linked(nothing).count() == 0


def test_quality_metrics_and_bound(spark, docs, rows, nothing):
    labels = spark.createDataFrame([(0, 1, 0), (1, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = sorted((tuple(r)[:6] for r in quality.judge(docs, labels).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()), key=str)
    want = []
    for i, t, *_ in rows:
        w = split(t)
        grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        twice, lines = Counter(grams), [x for x in (t or "").split("\n") if re.search(BLANK, x)]
        cover = {p for k, g in enumerate(grams) if twice[g] > 1 for p in (k, k + 1, k + 2)}
        want.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(cover)))
    assert got == sorted(want, key=str)
    assert quality.judge(nothing, labels).count() == 0 and quality.judge(docs, labels.limit(0)).filter("not base_failed and not kept").count() == 0
    import math

    for k, n in ((0, 700), (3, 1000), (50, 10000)):
        exact = math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(0.01) + (n - i) * math.log1p(-0.01)) for i in range(k + 1))
        assert spark.range(1).select(quality.binomial_tail(F.lit(k), F.lit(n), 0.01)).first()[0] == pytest.approx(exact, rel=1e-6)


def test_thresholds_reject_junk_only(spark):
    rng = random.Random(2)
    data = [(k, " ".join(prose(rng, 60)) + (" ###" * 40 if k % 4 == 0 else ""), "en") for k in range(6000)]
    d = spark.createDataFrame(data, "doc_id long, text string, lang string").repartition(4)
    labels = spark.createDataFrame([(k, int(k % 4 != 0), 0) for k in range(6000)], "doc_id long, quality int, toxic int")
    got = quality.keep_good(d, labels, quality.Risk(alpha=0.02))
    ids = {r[0] for r in got.select("doc_id").collect()}
    assert ids == {k for k in range(6000) if k % 4}


def test_thresholds_of_small_strata(spark):
    """217 good labels prove a cutoff in each of four strata; 216 do not, and the first failing step ends the tests."""
    rows = []
    for lang, good in (("a", 217), ("b", 216), ("c", 600), (None, 217)):
        rows += [(lang, True, 0.0, 0.0)] * good + [(lang, False, 0.45, 0.0)] * 30
    # three good rows of c reach a cutoff that pays; sixty the next one, which fails, so none after it is tried
    rows += [("c", True, 0.0, 0.25)] * 3 + [("c", False, 0.0, 0.25)] * 40 + [("c", True, 0.0, 0.12)] * 60 + [("c", False, 0.0, 0.12)] * 5 + [("c", False, 0.07, 0.0)] * 900
    data = spark.createDataFrame(rows, "lang string, good boolean, symbol_share double, repeat_share double")
    for r in quality.RULES:
        data = data if r in data.columns else data.withColumn(r, F.lit(0.0))
    got = {(r["stratum"], r["rule"], r["cutoff"], r["n_good_rejected"], r["n_junk_rejected"]) for r in quality.thresholds(data, "lang", "good", quality.Risk()).collect()}
    assert got == {("a", "symbol_share", 0.4, 0, 30), (None, "symbol_share", 0.4, 0, 30), ("c", "symbol_share", 0.4, 3, 70), ("c", "repeat_share", 0.2, 3, 70)}


def test_benchmark_leaks(spark, docs, rows):
    item = " ".join(split(rows[0][1])[20:60])
    edited = " ".join(split(item)[:15] + ["x"] + split(item)[16:])
    bench = spark.createDataFrame([(1, edited), (2, "too short"), (3, None), (4, " ".join(f"q{k}" for k in range(30)))], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["distance"]) for r in decontaminate.leaks(docs, bench).collect()}
    assert got == {(0, 1, 1), (1, 1, 1), (2, 1, 1)}
    assert {r["doc_id"] for r in decontaminate.without_leaks(docs, bench).collect()} == {r[0] for r in rows} - {0, 1, 2}
    assert decontaminate.leaks(docs, bench.limit(0)).count() == 0


def test_short_items_match_exactly(spark):
    texts = ["say Open, sesame door now", "open sesame", "open the sesame door", "sesame door open", None, "sesame", "a b c d e f g and more", "a b c d x f g and more"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(1, "open sesame door"), (2, "Sesame!"), (3, "a b c d e f g"), (4, " ")], "item_id long, text string")
    got = {tuple(r) for r in decontaminate.leaks(d, bench).collect()}
    assert got == {(0, 1, 0, 1, 3), (0, 2, 0, 2, 2), (1, 2, 0, 1, 1), (2, 2, 0, 2, 2), (3, 2, 0, 0, 0), (5, 2, 0, 0, 0), (6, 3, 0, 0, 6)}
    assert {r["doc_id"] for r in decontaminate.without_leaks(d, bench).collect()} == {4, 7}


def test_myers_equals_dynamic_programming():
    rng = random.Random(3)
    for _ in range(200):
        p, x = [rng.choice("abc") for _ in range(rng.randint(1, 9))], [rng.choice("abc") for _ in range(rng.randint(0, 15))]
        col = list(range(len(p) + 1))
        best = col[-1]
        for c in x:
            new = [0]
            for i, y in enumerate(p):
                new.append(min(col[i] + (y != c), new[i] + 1, col[i + 1] + 1))
            col = new
            best = min(best, col[-1])
        assert decontaminate.myers(p, x)[0] == best


def test_packing(docs, rows, nothing):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = [r.asDict() for r in packing.pack(docs, capacity=128).collect()]
    fill = Counter()
    for r in got:
        fill[r["sequence_id"]] += r["length"]
    assert all(n == 128 or n & (n - 1) == 0 for n in fill.values()) and sum(n < 128 for n in fill.values()) <= 7
    assert sum(r["length"] for r in got) == sum(len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, *_ in rows)
    for i, t, *_ in rows:
        if i is not None and sum(r[0] == i for r in rows) == 1:
            ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4")
            at = 0
            for p in sorted((r for r in got if r["doc_id"] == i), key=lambda r: r["start"]):
                assert p["start"] == at and p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
                at += p["length"]
            assert at == len(ids)
    assert packing.pack(nothing).count() == 0


def test_plans_fill_windows():
    rng = random.Random(4)
    for _ in range(20):
        h = Counter(rng.randint(1, 64) for _ in range(rng.randint(0, 150)))
        records, n = packing.plan(dict(h), 64)
        seq = {}
        for _, r0, r1, _, size, s, i0, k, at in records:
            for r in range(r0, r1):
                seq.setdefault(s + (r - r0 + i0) // k, []).append((at + (r - r0 + i0) % k * size, size))
        assert len(seq) == n
        for v in seq.values():
            end = 0
            for a, size in sorted(v):
                assert a == end
                end += size
            assert end == 64 or end & (end - 1) == 0


def test_toxicity(spark, nothing):
    rng = random.Random(5)
    data = [(k, " ".join(prose(rng, 40) + (["scoundrel"] * (1 + k % 3) if k % 5 == 1 else [])), "en") for k in range(1500)] + [(None, "scoundrel", "en"), (9999, None, "en")]
    d = spark.createDataFrame(data, "doc_id long, text string, lang string").repartition(3)
    labels = spark.createDataFrame([(k, 1, int(k % 5 == 1)) for k in range(1500)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.scored(d, labels).collect()}
    held = [k for k in range(1500) if zlib.crc32(str(k).encode()) % 5 == 0]
    assert all(got[k]["held_out"] for k in held) and not got[None]["held_out"]
    assert np.mean([got[k]["predicted"] == int(k % 5 == 1) for k in held]) > 0.98
    assert toxicity.scored(nothing.select("doc_id", "text"), labels).count() == 0
    assert {r["score"] for r in toxicity.scored(d.limit(5), labels.limit(0)).collect()} == {0.0}


def test_toxicity_keeps_less_frequent_words(spark, monkeypatch):
    """Toxic words count however many neutral ones are more frequent."""
    monkeypatch.setattr(toxicity, "KNOWN", 8, raising=False)
    rng = random.Random(8)
    data = [(k, " ".join(prose(rng, 40) + ["neutral", "ordinary"] + ["scoundrel"] * (k % 5 == 1))) for k in range(600)]
    d = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(k, 1, int(k % 5 == 1)) for k in range(600)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["predicted"] for r in toxicity.scored(d, labels).collect()}
    assert np.mean([got[k] == int(k % 5 == 1) for k in range(600)]) > 0.98


def test_toxicity_of_rare_words(spark):
    """A word of six toxic documents and of no other counts."""
    rng = random.Random(9)
    bad = {k for k in range(1, 200) if zlib.crc32(str(k).encode()) % 5}
    bad = set(sorted(bad)[:6])
    data = [(k, " ".join(prose(rng, 40) + ["scoundrel"] * (k in bad))) for k in range(200)] + [(1000, " ".join(prose(rng, 40) + ["scoundrel"])), (1001, " ".join(prose(rng, 40)))]
    d = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(k, 1, int(k in bad)) for k in range(200)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.scored(d, labels).collect()}
    assert got[1000]["predicted"] == 1 and got[1001]["predicted"] == 0 and all(got[k]["predicted"] == int(k in bad) for k in range(200))


def test_url_rules(spark):
    urls = [None, "abc", "HTTP://Ex.NET", "a://org/fr/x?y://z", "http://A.net/q", "http://www.example.net/en/1", "http://example.net/de/", "https://x.example.com/de/2#t", "http://a.fr/fr/1?x=1&y=2"]
    d = spark.createDataFrame([(k, u, "") for k, u in enumerate(urls)], "page_id long, url string, html string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judged(d).collect()}
    assert got[0][:3] == got[1][:3] == ("", "", None) and got[2][:3] == ("ex.net", "", None)
    assert got[3] == ("org", "/fr/x", "org/fr/", "allow") and got[4] == ("a.net", "/q", "net/", "block")
    assert got[5][2:] == ("example.net/en/", "allow") and got[6][2:] == ("net/", "block") and got[7][2:] == ("example.com/de/", "block")
    assert url_filter.judged(d.limit(0)).count() == 0
    rng = np.random.default_rng(6)
    x = rng.normal(size=(800, 9))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    trees = url_filter.Trees(x[:600], y[:600], url_filter.Boosting(trees=60))
    assert ((trees.predict(x[600:]) > 0.5) == y[600:]).mean() > 0.85


def test_warc_round_trip(spark):
    pages = [(1, "http://a", "x" * 5000), (2, None, "x" * 5000), (3, "http://c\r\nX: y", ""), (4, "d", None), (5, "e", "é\r\n\r\n"), (None, "f", "é\r\n\r\n"), (6, "g", "only")]
    d = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(2)
    got = {r["page_id"]: tuple(r)[1:] for r in warc.archived(d).collect()}
    last = {}
    for i, _, h in pages:
        last[h or ""] = max(i or -1, last.get(h or "", -1))
    for i, _, h in pages:
        raw = (h or "").encode()
        same = last[h or ""] == i
        assert got[i] == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if same else "revisit", None if same else last[h or ""])
    assert warc.archived(d.limit(0)).count() == 0


def test_normaliser_rewrites_members(tmp_path):
    import gzip

    from pyarrow import fs

    data = [warc.record("response", k, "u", bytes([65 + k]) * (k * 1000)) for k in range(5)]
    (tmp_path / "a.gz").write_bytes(gzip.compress(b"".join(data)))
    files = fs.LocalFileSystem()
    assert warc.normalise(files, str(tmp_path / "a.gz"), str(tmp_path / "b.gz")) == 5
    lines = (tmp_path / "b.gz.idx").read_text().splitlines()
    raw = (tmp_path / "b.gz").read_bytes()
    for line, want in zip(lines, data, strict=True):
        at, n, _ = line.split("\t")
        assert gzip.decompress(raw[int(at) : int(at) + int(n)]) == want
    (tmp_path / "c.gz").write_bytes(gzip.compress(b"".join(data)[:-30]))
    with pytest.raises(ValueError):
        warc.normalise(files, str(tmp_path / "c.gz"), str(tmp_path / "d.gz"))


def test_license_scan(docs, spark, nothing):
    notice = "Permission is hereby granted, free of charge, to any person obtaining a copy of this cool software and associated documentation files, to deal in the Software without restriction!"
    d = spark.createDataFrame([(1, f"xx {notice} bla cc-by MIT License"), (2, None), (None, "Apache License"), (3, "cc  by cc by"), (4, "accby mit-licenses")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in license_scan.scan(d).collect()}
    assert got[1]["labels"] == "cc-by,mit,mit-notice" and got[1]["base_labels"] == "cc-by,mit" and got[1]["spans"][0]["similarity"] > 0.9
    assert (got[2]["n_words"], got[2]["labels"], got[2]["score"], got[2]["first_word"]) == (0, "", 0.0, None)
    assert got[None]["base_labels"] == "apache" and (got[3]["n_base"], got[3]["first_word"], got[3]["last_word"]) == (2, 0, 2) and got[4]["n_base"] == 0
    assert license_scan.scan(nothing).count() == 0 and license_scan.scan(docs).count() == docs.count()


def test_words_of_letters_are_encoded_together_as_alone():
    import public_tokenizers

    from lattica.llm.packing import WordIds

    encode = WordIds(public_tokenizers.path("word_bpe_49k.json"), 2)
    lines = []

    class Counted:
        def __init__(self, inner):
            self.inner = inner

        def encode_batch_fast(self, texts, **more):
            lines.extend(texts)
            return self.inner.encode_batch_fast(texts, **more)

    plain, encode.tokenizer = encode.tokenizer, Counted(encode.tokenizer)
    letters = [f"wo{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}rd" for i in range(600)]
    odd = "İstanbul ΣΑΣ ß, ǅ. ﬁ ªº straße### don't it's l'été 'tis a</w> </w> 日本語 テスト がぎ ก็ हिन्दी ٣٤ ⅷ 𝒜𝓑 ʰa \U00010d50 (x) --- a--- é!? Éa,*** x</w>y"
    texts = [" ".join(letters).encode(), odd.encode(), b"", b"bad \xff bytes", " ".join(f"{w}###" for w in letters).encode()]
    want = [[*plain.encode(t.decode("utf-8", "replace"), add_special_tokens=False).ids, 2] for t in texts]
    assert [np.frombuffer(ids, "<u4").tolist() for ids in encode(texts)] == want
    assert len(lines) < 200  # 600 words of letters in one line, and again if one of a line is no single run of letters


def test_a_task_gives_its_freed_memory_back(monkeypatch):
    import pyarrow as pa

    from lattica.llm import words

    calls = []
    monkeypatch.setattr(words, "_give_back", lambda: calls.append(1))
    batches = [pa.RecordBatch.from_arrays([pa.array(["a b", None, "c"])], names=["text"])] * 2
    parts = words.segments(iter(batches), "text", 2)
    assert next(parts)[1] == [b"a b", b""] or not calls
    assert b"".join(t for _, texts in parts for t in texts).endswith(b"c") and calls == [1]


def _peak(run) -> float:
    """MB that Python and numpy hold at most while this runs."""
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


class _Caught:
    """Stands for a table; keeps the function given to mapInArrow."""

    sparkSession = None  # noqa: N815

    def mapInArrow(self, run, schema):  # noqa: N802
        self.run = run
        raise StopIteration


def test_texts_of_a_batch_are_copied_a_segment_at_a_time():
    import pyarrow as pa

    from lattica.llm.words import segments

    texts = [b"x" * 300_000, None, b"", "é".encode() * 1000] * 60
    for kind in (pa.string(), pa.large_string(), pa.binary()):
        batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()).cast(kind)], names=["text"])
        assert [t for _, part in segments(iter([batch]), "text") for t in part] == [t or b"" for t in texts]
        assert [len(rows) for rows, _ in segments(iter([batch]), "text")] == [len(part) for _, part in segments(iter([batch]), "text")]
        assert _peak(lambda: [None for _ in segments(iter([batch.slice(4)]), "text")]) < 5  # 18 MB in all  # noqa: B023


def test_a_task_gives_memory_back_when_it_holds_none(monkeypatch):
    from lattica.llm import words

    held, left = [], []
    monkeypatch.setattr(words, "_give_back", lambda: left.append([x() for x in held]))

    def run(batches):
        large = np.zeros(1000)
        held.append(weakref.ref(large))
        for b in batches:
            yield b + len(large)

    assert list(words.lean(run)(iter([1, 2]))) == [1001, 1002] and left == [[None]]


def test_sketch_holds_few_copies_of_the_values_it_counts():
    from lattica.llm import shared

    values = np.random.default_rng(3).integers(0, 1 << 63, 3_000_000, dtype=np.uint64)
    values[1_000_000:1_500_000] = values[:500_000]
    caught = _Caught()
    with pytest.raises(StopIteration):
        shared.sketch(caught, lambda _: iter(np.split(values, 30)), shared.BLOCK * 256, 2)
    out = []
    assert _peak(lambda: out.extend(caught.run(iter([])))) < 60
    cells, counts = np.unique(values[:2_100_000] >> np.uint64(36), return_counts=True)
    first = out[0].to_pydict()  # 21 pieces reach the size of a flush
    once = np.concatenate([b * shared.BLOCK + np.frombuffer(x, np.uint32) for b, x in zip(first["block"], first["once"], strict=True)])
    more = np.concatenate([b * shared.BLOCK + np.frombuffer(x, np.uint32) for b, x in zip(first["block"], first["more"], strict=True)])
    assert np.array_equal(once, cells) and np.array_equal(more, cells[counts > 1]) and len(more) >= 500_000
    assert sum(sum(b.to_pydict()["n"]) for b in out) == len(values)


def test_packing_forgets_its_words_when_a_worker_has_no_task(monkeypatch):
    monkeypatch.setattr(packing, "IDLE_SECONDS", 0.2)
    encode = packing._remembering(None, 2)
    before = encode([b"some words"])
    packing._pause()
    assert packing._remembering(None, 2) is encode  # the next task comes soon
    time.sleep(0.5)
    assert packing._remembering(None, 2) is encode  # and takes long
    packing._pause()
    time.sleep(0.5)
    again = packing._remembering(None, 2)
    assert again is not encode and encode([b"some words"]) == again([b"some words"]) == before


def test_packing_chains_no_python_workers(docs):
    plan = packing.pack(docs, capacity=64)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1
