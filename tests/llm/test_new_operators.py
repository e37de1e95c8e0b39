"""Ball k-means, language identification and the filter audit against brute force, on the small table and on odd rows."""

import collections
import hashlib
import itertools
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import types as T

queries = pytest.importorskip("docketry.llm.queries")

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_kmeans(rows, k=40, rounds=5):
    """vec_id -> (cluster, distance), inertias and centroids of rows (vec_id, whole numbers)."""
    order = sorted(rows, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [list(v) for _, v in order[:k]]
    for n in range(rounds + 1):
        found = [min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(centroids)) for _, v in rows]
        if n < rounds:
            for i in range(len(centroids)):
                members = [v for (_, v), (_, c) in zip(rows, found) if c == i]
                if members:
                    centroids[i] = [sum(x) // len(members) for x in zip(*members)]
    inertia = collections.Counter()
    for d, c in found:
        inertia[c] += d
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted((-1 if i is None else i, c, d, inertia[c], sum(inertia.values()), shas[c]) for (i, _), (d, c) in zip(rows, found))


def told(rows):
    return sorted((-1 if r.vec_id is None else r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in rows)


VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("cluster", T.StringType()), T.StructField("v", T.StringType()), T.StructField("distance", T.StringType())])


def test_op11_odd_vectors(spark, tmp_path):
    """Wrong lengths, nulls and values that are not finite go; repeated rows, ties and clashing columns stay."""
    r = random.Random(3)
    good = [(i, [r.uniform(-1, 1) for _ in range(64)]) for i in range(150)]
    good += [(None, good[0][1]), (5, good[5][1]), (5, good[6][1]), *((200 + i, [0.0] * 63 + [1.0 / 256]) for i in range(70)), (400, [-1500.0] * 64)]
    bad = [(900, None), (901, [0.5] * 63), (902, [0.5] * 65), (903, [0.5] * 63 + [None]), (904, [0.5] * 63 + [float("nan")]), (905, [float("inf")] + [0.5] * 63), (906, [])]
    spark.createDataFrame([(i, v, "x", "y", "z") for i, v in good + bad], VECTORS).repartition(5).write.parquet(f"{tmp_path}/embeddings.parquet")
    kept = [(i, np.floor(256 * np.array(v, np.float32).astype(float)).astype(int).tolist()) for i, v in good]
    assert told(queries.QUERIES["op11_ball_kmeans"](spark, str(tmp_path)).collect()) == plain_kmeans(kept)


def test_op11_few_vectors_and_large_values(spark, tmp_path):
    from docketry.llm import ball_kmeans

    few = [(i, [float(i * j) for j in range(64)]) for i in range(3)]
    spark.createDataFrame([(i, v, "x", "y", "z") for i, v in few], VECTORS).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert told(queries.QUERIES["op11_ball_kmeans"](spark, str(tmp_path)).collect()) == plain_kmeans([(i, [int(256 * x) for x in v]) for i, v in few])
    with pytest.raises(Exception, match="too large"):
        ball_kmeans.cluster(spark.createDataFrame([(1, [1e9] * 64)], "vec_id bigint, embedding array<float>"), 2)


def test_balls_spare_comparisons(spark):
    """Twelve clouds: the same clusters as by comparing all, with few comparisons after the first round."""
    from docketry.llm import ball_kmeans

    r = np.random.default_rng(1)
    centres = r.uniform(-4, 4, (12, 8))
    rows = [(i, (centres[i % 12] + r.normal(0, 0.05, 8)).tolist()) for i in range(1200)]
    counts = []
    got = ball_kmeans.cluster(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), 12, size=8, counts=counts).collect()
    assert told(got) == plain_kmeans([(i, np.floor(256 * np.array(v)).astype(int).tolist()) for i, v in rows], k=12)
    assert counts[0] == 12 * 1200 and counts[-1] < counts[0] / 3


def test_assign_is_exact_on_ties():
    from docketry.llm.ball_kmeans import assign

    r = np.random.default_rng(2)
    for scale in (2, 5, 1 << 22):
        for _ in range(40):
            x, c = r.integers(-scale, scale + 1, (60, 3)), r.integers(-scale, scale + 1, (9, 3))
            c[3] = c[7]
            full = ((x[:, None] - c[None]) ** 2).sum(2)
            cluster, distance, _ = assign(x, r.integers(0, 9, 60), c)
            assert (cluster == full.argmin(1)).all() and (distance == full.min(1)).all()


def learn_from(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 != 0


def phrase_count(text, sample):
    """Longest parts of the sample, one after another, in pieces as the parser cuts them."""
    from docketry.llm.language_id import SEGMENT

    n = 0
    for k in range(0, len(text), SEGMENT):
        piece = text[k : k + SEGMENT]
        while piece:
            size = 1
            while size < len(piece) and piece[: size + 1] in sample:
                size += 1
            n, piece = n + 1, piece[size:]
    return n


def test_op12(spark, sf):
    """Held-out accuracy on the table; a learned language or und in every row."""
    rows = queries.QUERIES["op12_language_id"](spark, sf).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    assert all(r.held_out != learn_from(r.doc_id) and 0 <= r.score <= 1 for r in rows)
    letters = [r for r in rows if re.search(r"[^\W\d_]", docs[r.doc_id].text)]
    held = [r for r in letters if r.held_out]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) >= 0.95 * len(held) > 0
    assert {r.lang_pred for r in letters} <= {r.lang for r in docs.values()}


def test_op12_counts_phrases_as_a_plain_parser(spark):
    import pyarrow as pa
    from docketry.llm import language_id

    r = random.Random(4)
    say = lambda letters, n: "".join(r.choices(letters, k=n))
    texts = {"aa": say("abc de", 900), "bb": say("defé b", 1500), "cc": say("xyz", 5)}
    samples = {k: language_id.signs(pa.array([v]))[1].tobytes() for k, v in texts.items()}
    model = language_id.fit_samples(samples)
    asked = ["", "a", "ABC, DE! 12 ab", "é", "漢字 abc", "zzz qqq", say("abcdeé xyz", 3000), *(say("abc de", n) for n in (511, 512, 513, 1024, 1025)), say("defé b", 700)]
    at, data = language_id.signs(pa.array(asked))
    got = language_id.phrases(model, at, data)
    for i in range(len(asked)):
        piece = data[at[i] : at[i + 1]].tobytes()
        assert got[i].tolist() == [phrase_count(piece, samples[k]) for k in sorted(samples)], asked[i][:40]


def test_suffix_automaton_has_all_parts_and_no_others():
    from docketry.llm.language_id import suffix_automaton

    r = random.Random(6)
    for _ in range(30):
        text = bytes(r.choices(b"ab", k=r.randint(1, 30)))
        step = suffix_automaton(text)

        def accepts(part):
            at = 0
            for sign in part:
                at = step[at].get(sign)
                if at is None:
                    return False
            return True

        assert len(step) <= 2 * len(text)
        for n in range(1, 8):
            for part in map(bytes, itertools.product(b"abc", repeat=n)):
                assert accepts(part) == (part in text)


def test_op12_odd_rows(spark, tmp_path):
    """Null, empty, without letters, unseen script, very long, repeated, no doc_id, no lang; clashing columns."""
    r = random.Random(7)
    own = {"l1": "ba be bi bo bu da de di".split(), "l2": "orx urx irx arx mex nox".split()}
    rows = [(i, " ".join(r.choices(own[lang], k=40)), lang, "s") for i, lang in enumerate(["l1", "l2"] * 40)]
    odd = [None, "", "  12 .,;-", "— “…”", "漢字", "orx urx", "orx urx", "ba be " * 400_000]
    rows += [(1000 + i, t, None, None) for i, t in enumerate(odd)] + [(None, "ba be bi", "l1", None), (1, "orx mex nox", None, None)]
    spark.createDataFrame([(*x, "p", "q") for x in rows], "doc_id bigint, text string, lang string, source string, score string, letter string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op12_language_id"](spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got if r.doc_id != 1}
    assert [by[1000 + i].lang_pred for i in range(4)] == ["und"] * 4 and by[1000].score == 0
    assert by[1004].lang_pred in own and by[1005].lang_pred == by[1006].lang_pred == "l2" and by[1007].lang_pred == "l1"
    assert by[None].lang_pred == "l1" and by[None].held_out
    assert sorted(r.lang_pred for r in got if r.doc_id == 1) == ["l2", "l2"]
    assert all(by[i].lang_pred == lang for i, _, lang, _ in rows[:80] if i != 1)


def test_op12_without_labels(spark, tmp_path):
    spark.createDataFrame([(1, "some text", None), (2, None, "xx")], "doc_id bigint, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {(r.lang_pred, r.score) for r in queries.QUERIES["op12_language_id"](spark, str(tmp_path)).collect()} == {("und", 0.0)}


def plain_audit(docs, labels):
    """(part, order, step) -> the eight counts, document by document."""
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    good, toxic = {i for i, q, _ in labels if q == 1} - {None}, {i for i, _, x in labels if x == 1} - {None}
    marked = []
    for i, t, s in docs:
        t = t or ""
        w = WORD.findall(t)
        fails = [c for c, f in zip("ABCDE", (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), re.search(r"[#$%&*|]", t), i is not None and first.get(t, i) < i)) if f]
        marked.append((s or "", frozenset(fails), i in good, i in toxic))
    out, shapley = {}, collections.Counter()
    parts = {m[0] for m in marked}
    groups = collections.Counter(marked)
    for order in itertools.permutations("ABCDE"):
        for step, letter in enumerate(order):
            before = set(order[:step])
            for part in parts:
                c = collections.Counter()
                for (p, fails, g, x), n in groups.items():
                    if p != part:
                        continue
                    gone = letter in fails and not fails & before
                    c["kept"] += n * (not fails & (before | {letter}))
                    c["removed"] += n * gone
                    c["redundant"] += n * (letter in fails and bool(fails & before))
                    c["unique_fails"] += n * (fails == {letter})
                    c["good_lost"] += n * (gone and g)
                    c["toxic_lost"] += n * (gone and x)
                shapley[part, letter] += c["removed"]
                out[part, "".join(order), step + 1] = c
    for (part, order, step), c in out.items():
        c["shapley"] = shapley[part, order[step - 1]]
    return out


COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def same_audit(rows, wanted):
    assert len(rows) == len(wanted)
    for r in rows:
        assert {c: r[c] for c in COUNTS} == {c: wanted[r.part, r.filter_order, r.step][c] for c in COUNTS}, r


def test_op13_odd_rows(spark, tmp_path):
    """Null and empty texts, 3 MB, copies in several sources, repeated rows and labels, no doc_id, clashing columns."""
    r = random.Random(9)
    words = ["".join(r.choices("abcdeé", k=r.randint(1, 14))) for _ in range(150)]
    say = lambda n: " ".join(r.choices(words, k=n))
    long = " ".join(f"word{i}q" for i in range(260_000))
    base = say(200)
    texts = [None, "", "", long, long, long[:-1] + "x", base, base, base[:-1] + "è", base + " #", "A" * 60, " ".join(["Aa bb"] * 40), "é" * 300, "e" * 300, *(say(n) for n in (49, 50, 51, 80)), *([say(70)] * 30), "a\u0085b " * 60]
    docs = [(50 + i * 7 % 61 + 100 * (i // 61), t, [None, "s1", "s2", ""][i % 4]) for i, t in enumerate(texts)]
    docs += [docs[6], docs[7], (None, base, "s1"), (None, "only here", "s1"), (docs[6][0], "other text of this id", "s2"), (3, base, "s3")]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1, None])) for i, _, _ in docs if i is not None and r.random() < 0.7] * 2 + [(None, 1, 1), (9999, 1, 1), (3, 0, 1), (3, 1, 0)]
    spark.createDataFrame([(*d, "x", "y", 1) for d in docs], "doc_id bigint, text string, source string, part string, mask string, class int").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    same_audit(queries.QUERIES["op13_filter_audit"](spark, str(tmp_path)).collect(), plain_audit(docs, labels))


def test_op13_hashes_that_meet(spark):
    """Texts whose keys agree are still told apart by the whole text."""
    from docketry.llm import filter_audit

    docs = [(5, "abcd", 1), (2, "abcd", 1), (9, "wxyz", 1), (3, "wxyz", 1), (4, "qqqq", 1), (7, "abcd", 1), (8, "zz", 2), (6, "zz", 2), (1, "alone", 3), (None, "zz", 2)]
    texts = spark.createDataFrame([(i, k, t) for i, t, k in docs], "doc_id bigint, text_key bigint, text string")
    scan = texts.selectExpr("doc_id", "text_key", "0 AS mask")
    firsts = filter_audit.first_copies(texts, spark.createDataFrame([(1, 0), (2, 0)], "text_key bigint, class bigint"))
    assert sorted((r.text_key, r.n_texts, r["first"]) for r in firsts.collect()) == [(1, 3, 2), (2, 1, 6)]
    rows = filter_audit.marked(scan, texts, firsts).collect()
    assert len(rows) == len(docs) and sorted(r.doc_id for r in rows if r["mask"]) == [5, 7, 8, 9]


def test_distinct_words_is_exact():
    import pyarrow as pa
    from docketry.llm.common import Words
    from docketry.llm.filter_audit import distinct_words

    r = random.Random(11)
    pool = ["".join(r.choices("ab\0", k=r.randint(1, 20))) for _ in range(80)]
    word = "a"
    for _ in range(11):
        word += word.translate({97: 98, 98: 97})
    texts = [" ".join(r.choices(pool, k=r.randint(0, 200))) for _ in range(60)] + [None, "", word + " " + word.translate({97: 98, 98: 97})]
    assert distinct_words(Words(pa.array(texts))).tolist() == [len(set(WORD.findall(t or ""))) for t in texts]


@pytest.mark.parametrize("name", ["op11_ball_kmeans", "op12_language_id", "op13_filter_audit"])
def test_empty(spark, sf, tmp_path, name):
    for t in ("documents", "labels", "embeddings"):
        spark.read.parquet(f"{sf}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert queries.QUERIES[name](spark, str(tmp_path)).collect() == []


@pytest.mark.parametrize("name", ["op11_ball_kmeans", "op13_filter_audit"])
def test_sql(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    wanted = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in wanted.description]
    assert sorted(queries.QUERIES[name](spark, sf).select(*columns).collect()) == sorted(wanted.fetchall())


def test_op4_composes_before_it_lowers_case():
    """Pairs of a capital and a mark that have a sign of their own in one case only, and many random texts."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    from docketry.llm.token_files import WordEncoder

    path = queries.public_file("word_bpe_49k.json")
    r, library = random.Random(12), Tokenizer.from_file(path)
    pairs = [a + chr(m) for a, m in (("H", 0x331), ("J", 0x30C), ("T", 0x308), ("T", 0x344), ("W", 0x30A), ("Y", 0x30A))]
    texts = [f"a {p} b {p}x x{p}. don't {p.lower()}" for p in pairs] + [a + chr(m) for a in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for m in range(0x300, 0x370)]
    signs = list("abcHJTWYİßé'.,!?1 \t\n  ") + [chr(m) for m in (0x301, 0x308, 0x30A, 0x30C, 0x331, 0x344, 0x345, 0x1E9E, 0x3A3, 0x4E00, 0x1F600, 0x130, 0x212A, 0xFB01)] + ["<|endoftext|>", "<|ENDOFTEXT|>", "Word"]
    texts += ["".join(r.choices(signs, k=r.randint(1, 24))) for _ in range(20_000)]
    encoder = WordEncoder(path, "uint32")
    wanted = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    for k in range(0, len(texts), 500):
        ids, ends = encoder.encode(pa.array(texts[k : k + 500]))
        begins = [0, *ends[:-1].tolist()]
        for i, (a, b) in enumerate(zip(begins, ends.tolist())):
            assert ids[a:b].tolist() == wanted[k + i], texts[k + i]


def test_op9_templated_items_stay_within_memory():
    """Five thousand items that begin alike against a text of such beginnings: millions of hits, little memory."""
    import tracemalloc

    import pyarrow as pa
    from docketry.llm import decontamination as D
    from docketry.llm.common import Words

    items = [f"which of the following is true about item{i} of kind{i % 97} and shape{i % 13} or size{i}" for i in range(5_000)]
    text = " ".join(f"which of the following is true about thing{i} here." for i in range(1200)) + " " + items[77]
    known = D.Benchmark(list(range(len(items))), items, D.EDITS_PERCENT, (2, 2, D.PLACES))
    words = Words(pa.array([text, "", None, items[5]]), lower=True, dividers=D._DIVIDERS)
    tracemalloc.start()
    found = [known._windows(r, words.hashes(), words.row_of_word(), words.first) for r in known.runs]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    begins = set(words.first[[0, 3]].tolist()) | {int(words.first[1]) - len(items[77].split())}
    assert peak < 300 << 20 and begins & {int(s) for start, _, _ in found for s in start}, peak


def test_op9_slices_change_nothing(monkeypatch):
    import numpy as np
    import pyarrow as pa
    from docketry.llm import decontamination as D
    from docketry.llm.common import Words

    r = random.Random(13)
    pool = [f"w{i}" for i in range(12)]
    items = [" ".join(r.choices(pool, k=r.randint(3, 25))) for _ in range(60)]
    text = " ".join(r.choices(pool, k=900)) + " " + items[4]
    known = D.Benchmark(list(range(60)), items, D.EDITS_PERCENT, (D.WALKS, D.SAMPLES, D.PLACES))
    words = Words(pa.array([text]), lower=True, dividers=D._DIVIDERS)
    whole = known.find(words)
    for hits in (1, 7, 1000):
        monkeypatch.setattr(D, "HITS", hits)
        assert all(np.array_equal(a, b) for a, b in zip(whole, known.find(words)))
