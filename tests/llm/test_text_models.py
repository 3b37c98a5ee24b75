"""Language identification, quality, language-model scores and BPE."""

import collections
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.llm import bpe, language_id, lm_score, quality
from tidemill.llm.queries import tokenizer_path


def test_language_of_odd_rows(odd, empty):
    dictionaries = language_id.sample(odd, "text", "lang")
    got = {r.doc_id: r for r in language_id.classify(odd, dictionaries).collect()}
    assert got[3].lang_pred == got[4].lang_pred == got[5].lang_pred == "und" and got[3].score == 0
    assert got[1].lang_pred == "en" and 0 <= got[1].score <= 1 and odd.count() == 12
    assert language_id.sample(empty, "text", "lang") == {}
    assert language_id.classify(odd, {}).filter("lang_pred <> 'und'").count() == 0
    assert language_id.classify(empty, dictionaries).count() == 0


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = language_id.held_out()
    dictionaries = language_id.sample(docs.filter(~held), "text", "lang")
    assert all(len(d) <= language_id.DICT_BYTES for d in dictionaries.values())
    got = language_id.classify(docs.filter(held), dictionaries)
    assert got.filter("lang = lang_pred").count() >= 0.97 * got.count()


def brute_quality(trusted, texts):
    """Mean loss by dictionaries: interpolated modified Kneser-Ney of order 4 over characters."""
    fold = lambda t: ["0" if c.isnumeric() else " " if c.isspace() else c for c in t]
    pad = ["<s>"] * 3
    full = collections.Counter(tuple((pad + fold(t))[i : i + 4]) for t in trusted for i in range(len(t)))
    levels = [full]
    while len(next(iter(levels[-1]))) > 1:
        levels.append(collections.Counter(g[1:] for g in levels[-1]))
    size = len({c for t in trusted for c in fold(t)}) + 2

    def cuts(c):
        n = [sum(x == i for x in c.values()) for i in range(5)]
        if not (n[1] and n[2]):
            return [0, 0.5, 0.75, 0.9]
        y = n[1] / (n[1] + 2 * n[2])
        return [0, *(min(max(i - (i + 1) * y * n[i + 1] / n[i] if n[i] else 0.5, 0.05), i - 0.01) for i in (1, 2, 3))]

    cut = [cuts(c) for c in levels]
    by = [collections.defaultdict(list) for _ in levels]
    for i, level in enumerate(levels):
        for g, n in level.items():
            by[i][g[:-1]].append(n)

    def p(g, i):
        if i == 4:
            return 1 / size
        known = by[i].get(g[:-1])
        low = p(g[1:], i + 1)
        if not known:
            return low
        d = lambda n: cut[i][min(n, 3)]
        own = levels[i].get(g, 0)
        return (max(own - d(own), 0) + sum(map(d, known)) * low) / sum(known)

    return [-sum(math.log(p(tuple((pad + fold(t))[i : i + 4]), 0)) for i in range(len(t))) / len(t) if t else None for t in texts]


WORDS = ["el", "gato", "the", "cat", "und", "Hund", "съешь", "мягких", "булок", "天地", "玄黄", "42", "é", "…", "x" * 30]


def test_quality_perplexity_equals_brute_force(spark):
    r = random.Random(9)
    say = lambda: r.choice([" ", "\n", "\t"]).join(r.choice(WORDS) for _ in range(r.randrange(1, 30)))
    trusted, texts = [say() for _ in range(60)], [*(say() for _ in range(40)), "ζζζ ###", "", None, "cat"]
    model = quality.learn(spark.createDataFrame([(t,) for t in trusted], "text string").repartition(3), "text")
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumns({"lang": F.lit("xx"), "c0": F.lit("mine"), "Keep": F.lit(1)})
    for options in ({}, {"batch_bytes": 300}):
        rows = quality.score(docs, model, **options)
        assert rows.columns == ["doc_id", "text", "lang", "c0", "n_symbols", "log_perplexity", "threshold", "keep"]
        got = {x.doc_id: x for x in rows.collect()}
        assert [got[i].text for i in range(len(texts))] == texts and all(x.c0 == "mine" for x in got.values())
        for i, want in enumerate(brute_quality(trusted, texts)):
            assert got[i].log_perplexity is want if want is None else abs(got[i].log_perplexity - want) < 1e-5, texts[i]


def test_quality_probabilities_sum_to_one(spark):
    model = quality.learn(spark.createDataFrame([("the cat sat on the mat. " * 20,), ("a mat",)], "text string"), "text")
    shards = {x.shard: x for x in model.counts.collect()}
    for context in ((1, 1, 1), (2, 3, 4), (9, 9, 3), (0, 0, 0)):
        keys = np.array([(context[0] << 48) | (context[1] << 32) | (context[2] << 16) | i for i in range(len(model.single))], np.uint64)
        x = shards[int(quality.shard_of(keys)[0])]
        logp = quality.prices(keys, quality.unpack_keys(x["keys"]), quality.unpack_numbers(x["counts"]), model.cuts, model.single)
        assert abs(np.exp(logp).sum() - 1) < 1e-9


def test_quality_keeps_clean_and_rejects_junk(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality.score(docs, quality.train(docs, labels)).join(labels, "doc_id").toPandas()
    assert got[got.quality == 1].keep.mean() >= 0.99
    assert got[got.quality == 0].keep.mean() <= 0.4


def test_quality_rejects_repeated_words(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = quality.score(docs, quality.train(docs, labels)).join(labels, "doc_id").toPandas()
    assert got[got.quality == 1].keep.mean() >= 0.98
    assert got[got.quality == 0].keep.mean() <= 0.12


def test_quality_threshold_follows_length():
    r = np.random.default_rng(6)
    n = r.integers(10, 5000, 3000)
    a, b = quality.line(n, 1.7 + r.normal(size=3000) / np.sqrt(n))
    for lo, hi in ((10, 300), (300, 2000), (2000, 5000)):
        x = r.integers(lo, hi, 20_000)
        assert (1.7 + r.normal(size=20_000) / np.sqrt(x) <= a + b / np.sqrt(x)).mean() > 0.98
    assert a < 1.72 and b > 1.5


@pytest.mark.parametrize("text", ["съешь же ещё этих мягких французских булок, да выпей чаю. ", "ξεσκεπάζω την ψυχοφθόρα βδελυγμία. ", "نص حكيم له سر قاطع وذو شأن عظيم. ", "天地玄黄宇宙洪荒日月盈昃辰宿列张。"])
def test_quality_tells_junk_in_other_scripts(spark, text):
    model = quality.learn(spark.createDataFrame([(text * 30,)], "text string"), "text")
    shuffled = list(text * 3)
    random.Random(7).shuffle(shuffled)
    rows = spark.createDataFrame(list(enumerate([text * 3, "".join(shuffled), text[0] * 90])), "doc_id long, text string").withColumn("lang", F.lit(None).cast("string"))
    mean = {r.doc_id: r.log_perplexity for r in quality.score(rows, model).collect()}
    assert mean[0] + 1 < mean[1] and mean[0] + 1 < mean[2]


def test_quality_of_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, None), (2, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(odd, labels)
    got = {r.doc_id: r for r in quality.score(odd, model).collect()}
    assert not got[3].keep and not got[4].keep and got[3].log_perplexity is None
    none = quality.train(odd, labels.limit(0))
    assert quality.score(odd, none).filter("keep").count() == 10
    assert quality.score(empty, model).count() == 0


def brute_base(rows):
    tokens = [(i, (t or "").encode().lower().split() + [None]) for i, t in rows]
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    c = collections.Counter(w for i, ws in tokens if i is not None and not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    return [(i, len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) for i, ws in tokens]


@pytest.mark.parametrize("options", [{}, {"batch_bytes": 3000, "bucket_bytes": 2000}])
def test_lm_base_is_exact(spark, options):
    r = random.Random(1)
    rows = [(i, " ".join(r.choice(["a", "B", "the", f"w{r.randrange(50)}"]) for _ in range(r.randrange(40)))) for i in range(150)] + [(None, "a b"), (7, None)]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in lm_score.score(spark.createDataFrame(rows, "doc_id long, text string"), **options).collect())
    assert got == sorted((i is None, i or 0, a, b, n, round(s, 6)) for i, a, b, n, s in brute_base(rows))


def test_lm_score_is_a_better_model_than_the_base(spark):
    got = lm_score.score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).filter("held_out").toPandas()
    assert got.score.sum() > got.base_score.sum() and (got.score <= 1e-9).all()


def test_filter_has_all_counts_and_few_false_ones():
    h = np.random.default_rng(2).integers(0, 2**63, 20_000).astype(np.uint64)
    bits, segment = 1 << 18, np.zeros(1 << 18, bool)
    inside, counts = h[:10_000], np.random.default_rng(3).integers(1, 40, 10_000)
    q = lm_score.levels_of(counts)
    for level in range(1, q.max() + 1):
        for probe in range(lm_score.PROBES):
            segment[lm_score.spots(inside[q >= level], level, probe, bits)] = True
    f = lm_score.Filter(np.packbits(segment, bitorder="little").tobytes(), bits)
    low = np.where(q == 1, 1, lm_score.BASE ** (q - 0.5))
    assert (f.count(inside) >= low).all() and (f.count(h[10_000:]) > 0).mean() < 0.1
    assert lm_score.levels_of(np.array([1, 2, 3, 4, 7, 8])).tolist() == [1, 2, 2, 3, 3, 4]


def brute_score(rows):
    """The score with quantised counts of no false positives."""
    tokens = [(i, ["<s>", *(t or "").lower().split(), "</s>"]) for i, t in rows]
    learnt = [ws for i, ws in tokens if zlib.crc32(str(i).encode()) % 7 != 2]
    words = collections.Counter(w for ws in learnt for w in ws)
    pairs = collections.Counter(p for ws in learnt for p in zip(ws, ws[1:]))
    n, v = sum(words.values()) - len(learnt), len(words) - 1
    quantised = lambda c: c if c < 2 else 2 ** (math.floor(math.log2(c)) + 0.5)
    share = lambda a, b: min(1.0, quantised(pairs[a, b]) / quantised(words[a])) if words[a] else 0.0
    return {i: sum(math.log10(0.7 * share(a, b) + 0.3 * (min(quantised(words[b]), n) + 1) / (n + v + 1)) for a, b in zip(ws, ws[1:])) for i, ws in tokens}


def test_lm_score_stays_near_exact_where_ngrams_are_many(spark):
    r = random.Random(4)
    rows = [(i, " ".join(chr(r.choice([*range(33, 65), *range(91, 127)])) for _ in range(20))) for i in range(200)]
    want = brute_score(rows)
    got = {x.doc_id: x.score for x in lm_score.score(spark.createDataFrame(rows, "doc_id long, text string"), batch_bytes=3000, bucket_bytes=2000).collect()}
    error = np.mean([abs(got[i] - want[i]) for i in want])
    assert error < 0.15, error


def test_filter_grows_and_stops_at_the_highest_level():
    h = np.random.default_rng(5).integers(0, 1 << 40, 400_000).astype(np.uint64)
    for n in (1000, 200_000):
        f = lm_score.fill([(h[:n], np.full(n, 5))])
        assert (f.level(h[:n]) == 3).all() and (f.level(h[200_000:]) > 0).mean() < 0.02
    full = lm_score.Filter(b"\xff" * 8, 64, 3)
    assert (full.count(h[:9]) == lm_score.BASE**2.5).all()


def test_lm_of_odd_and_empty_tables(odd, empty):
    got = lm_score.score(odd).collect()
    assert len(got) == 12 and all(r.n_tokens >= 1 for r in got)
    assert lm_score.score(empty).count() == 0


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    t.no_padding()
    t.no_truncation()
    return t


def test_bpe_equals_the_library(library):
    r = random.Random(2)
    mine = bpe.WordBpe(open(tokenizer_path(), encoding="utf-8").read())
    pool = "abcXYZ ΣσςİßÉé'sſK \x1c\x1d\x85\xa0١²Ⅷ½日本語😀!?.,-_<|>0123\n\tĳﬁ'LL're"
    texts = ["".join(r.choice(pool) for _ in range(r.randrange(40))) for _ in range(3000)]
    texts += ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randrange(1, 60))) for _ in range(3000)]
    texts += ["a<|endoftext|>b", "<|startoftext|>", "x <|ENDOFTEXT|> y", "it's we'LL I'd", "a" * 5000, ""]
    ids, said = mine.encode(texts)
    for text, i, s, e in zip(texts, ids, said, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(i, np.int32).tolist() == e.ids, text
        assert s == library.decode(e.ids, skip_special_tokens=False)
    assert 0 < mine.merged < mine.proposed


def test_bpe_long_and_short_merging_agree():
    mine = bpe.WordBpe(open(tokenizer_path(), encoding="utf-8").read())
    r = random.Random(3)
    for _ in range(300):
        symbols = [*("".join(r.choice("etaoinsr") for _ in range(r.randrange(1, 39)))), "e</w>"]
        assert mine.merge(symbols) == mine.merge_long(symbols)


def test_bpe_columns(odd, empty, library):
    coded = bpe.encode(odd, tokenizer_path())
    got = {r.doc_id: r for r in coded.collect()}
    assert got[3].ids == [] and got[3].decoded == "" and got[9].ids == library.encode(got[9].text, add_special_tokens=False).ids
    again = {r.doc_id: r.decoded for r in bpe.decode(coded.drop("decoded"), tokenizer_path()).collect()}
    assert again == {i: r.decoded for i, r in got.items()}
    assert bpe.digests(bpe.encode(empty, tokenizer_path())).count() == 0


def test_bpe_of_clashing_names(spark, library):
    docs = spark.createDataFrame([(1, "Hello there", 5, "d", 2)], "doc_id long, text string, IDS int, decoded string, n_tokens int")
    coded = bpe.encode(docs, tokenizer_path())
    assert coded.columns == ["doc_id", "text", "n_tokens", "ids", "decoded"]
    assert coded.first().ids == library.encode("Hello there", add_special_tokens=False).ids and bpe.digests(coded).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_language_of_clashing_names_and_long_texts(spark):
    docs = spark.createDataFrame([(None, "the cat sat " * 50_000, "en", 1, 2.0), (2, "der Hund lag " * 40, "de", 1, 2.0)], "doc_id long, text string, lang string, LANG_PRED int, score double")
    got = language_id.classify(docs.drop("lang"), language_id.sample(docs, "text", "lang"))
    assert got.columns == ["doc_id", "text", "lang_pred", "score", "reliable"]
    assert {r.doc_id: r.lang_pred for r in got.collect()} == {None: "en", 2: "de"}


def test_language_is_the_smallest_sum_of_compressed_blocks(spark):
    import zstandard

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    content = language_id.sample(docs.filter(~language_id.held_out()), "text", "lang")
    got = {r.doc_id: r for r in language_id.classify(docs.select("doc_id", "text"), content).collect()}
    for row in docs.collect():
        if not row.text or not any(map(str.isalpha, row.text)):
            assert got[row.doc_id].lang_pred == "und"
            continue
        t = language_id.letters(row.text)
        size = {}
        for k, c in content.items():
            d = zstandard.ZstdCompressionDict(c, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            coder = zstandard.ZstdCompressor(level=language_id.LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
            size[k] = sum(len(coder.compress(t[i : i + language_id.BLOCK])) for i in range(0, len(t), language_id.BLOCK))
        low = sorted(size.values())
        assert size[got[row.doc_id].lang_pred] == low[0] and got[row.doc_id].reliable == ((low[1] - low[0]) / low[0] >= language_id.MARGIN)


def test_words_are_the_same_in_pieces(monkeypatch):
    from tidemill.llm.common import Words

    r = random.Random(5)
    texts = [" ".join("x" * r.randrange(1, 40) + str(r.randrange(9)) for _ in range(r.randrange(60))).encode() for _ in range(80)] + [b"y" * 5000, b"", b" \n "]
    whole = Words(texts, True)
    monkeypatch.setattr(Words, "PIECE", 64)
    parts = Words(texts, True)
    assert all((getattr(whole, k) == getattr(parts, k)).all() for k in ("start", "end", "hash", "bounds")) and len(whole.hash) == sum(len(t.split()) for t in texts)


@pytest.mark.parametrize("batches,buckets", [(1, 1), (7, 5), (40, 30)])
def test_exchange_adds_up_and_answers_every_key(spark, batches, buckets):
    import pyarrow as pa

    from tidemill.llm.common import spread
    from tidemill.llm.exchange import Routes, count

    rows = [(b, k) for b in range(batches) for k in range(b % 3, 200, 1 + b % 4)]
    routes = Routes(batches, buckets, (0,), 1)
    hashed = lambda ks: np.array([(k * 0x9E3779B97F4A7C15) % 2**64 for k in ks], np.uint64)
    dealt = spread(spark.createDataFrame(rows, "batch int, k long"), batches, "batch")

    def ask(table):
        return routes.ask(table.column("batch")[0].as_py(), [count(hashed(table.column("k").to_pylist()))[:2]])

    replies = routes.run(dealt, ask, lambda counted: ([counted[0][1]], [len(counted[0][0])]))
    total = collections.Counter(k for _, k in rows)

    def check(table, said):
        keys, _, back = count(hashed(table.column("k").to_pylist()))
        (values,), (kinds,) = routes.read(said)
        return pa.table({"k": table.column("k"), "n": pa.array(values.astype(np.int64)[back]), "kinds": pa.array([kinds] * table.num_rows, pa.int64())})

    got = dealt.groupBy("batch").cogroup(replies.groupBy("batch")).applyInArrow(check, "k long, n long, kinds long").collect()
    assert len(got) == len(rows) and all(x.n == total[x.k] and x.kinds == len(total) for x in got)


def test_quality_learns_from_every_trusted_row(spark, monkeypatch):
    r = random.Random(4)
    texts = [" ".join(r.choice(WORDS) for _ in range(4)) for _ in range(7000)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    labels = docs.select("doc_id", F.lit(1).alias("quality"), (F.col("doc_id") % 10 == 0).cast("int").alias("toxic"))
    weights = []
    line = quality.line
    monkeypatch.setattr(quality, "SENT_IDS", 3000)
    monkeypatch.setattr(quality, "line", lambda n, mean, weight: weights.append(int(weight.sum())) or line(n, mean, weight))
    model = quality.train(docs, labels)
    symbols = sum(int(quality.unpack_numbers(x["counts"]).sum()) for x in model.counts.collect())
    assert symbols == sum(len(t) for i, t in enumerate(texts) if i % 10)
    assert weights == [7000, 7000]


def test_quality_line_of_counted_documents():
    r = np.random.default_rng(8)
    n, mean, weight = r.integers(10, 900, 400), r.normal(2, 0.2, 400), r.integers(1, 9, 400)
    assert quality.line(n, mean, weight) == pytest.approx(quality.line(np.repeat(n, weight), np.repeat(mean, weight)))
    assert quality.quantile(mean, np.ones(400, np.int64)) == pytest.approx(np.quantile(mean, quality.QUANTILE))
