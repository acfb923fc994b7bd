"""Exact and near duplicates, repeats, mixing, BPE, toxicity and the pipeline against brute force."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from stackroom.llm import bpe as T
from stackroom.llm import exact_dedup as E
from stackroom.llm import mixing as M
from stackroom.llm import near_dup as N
from stackroom.llm import suffix_dedup as S
from stackroom.llm import toxicity as X
from stackroom.llm.components import components

from .test_rules_and_text import check_sql

WORD = re.compile(rb"[^\x20\t-\r]+")


def hard_documents(spark, sf_dir, n=150):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").limit(n).collect()]
    random.seed(4)
    near = []
    for k in range(25):
        words = rows[random.randrange(n)][1].split(" ")
        for _ in range(random.randrange(1, 1 + max(1, len(words) // 30))):
            words[random.randrange(len(words))] = f"new{random.randrange(99)}"
        near.append((7000 + k, " ".join(words), "src0"))
    base = " ".join(f"w{i}" for i in range(60))
    near += [(7100 + k, base.replace(f"w{k} ", f"v{k} ").replace(f"w{k + 30} ", f"u{k} "), "hot") for k in range(28)] + [(7099, base, "hot")]
    odd = [(8000, None, None), (8001, "", "a"), (8002, " \n ", "a"), (8003, "two words", "a"), (8004, "Two  WORDS", "z"), (8005, "long " * 20000, "a"), (8006, rows[0][1] + "\t", "b"), (8007, "é" * 300, None), (8008, "0123456789" * 30, "c"), (8009, "a" * 500, "c")]
    return rows + near + odd


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"size": F.lit("clash"), "key": F.lit(1), "keep_id": F.lit(2), "rep": F.lit(3)})


def test_exact_dedup(spark, sf_dir):
    rows = hard_documents(spark, sf_dir)
    df = frame(spark, rows)
    check_sql(spark, "op9_exact_dedup", {"documents": df.select("doc_id", "text")}, E.exact_dedup(df))
    got = {r["doc_id"]: r for r in E.exact_dedup(df).collect()}
    assert got[8001]["keep_id"] == 8000 and got[8006]["keep_id"] == 8006 and got[8000]["kept"] and len(got) == len(rows)


def test_exact_dedup_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, "a b"), (5, "a  b"), (5, "a b"), (None, "only")], "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["keep_id"] or -1, r["group_size"], r["kept"]) for r in E.exact_dedup(df).collect())
    assert got == [(-1, -1, 1, True), (-1, 5, 3, False), (5, 5, 3, True), (5, 5, 3, True)]


def test_empty_tables(spark):
    """Every operator and stage over tables without rows."""
    import corpus_pipeline as P

    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert E.exact_dedup(none).collect() == [] and M.mix_sources(none).collect() == [] and N.near_duplicates(none).collect() == []
    for _, stage in P.STAGES[1:]:
        assert stage(spark, none, "").collect() == []


def test_mixing(spark, sf_dir):
    rows = hard_documents(spark, sf_dir)
    df = frame(spark, rows)
    out = M.mix_sources(df).withColumn("target", F.round("target", 3))
    check_sql(spark, "op6_mix_sources", {"documents": df.select("doc_id", "text", "source")}, out)
    again = M.mix_sources(df.repartition(7)).select("doc_id", "taken")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, out.select("doc_id", "taken").collect()))
    assert out.where("taken > 2 * size OR copies < 0").count() == 0


def test_mixing_comes_near(spark, sf_dir):
    out = M.mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    per = out.groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("target"), F.max("size").alias("most")).collect()
    assert all(abs(r["t"] - r["target"]) <= 2 * r["most"] for r in per)
    total = out.agg(F.sum("size")).first()[0]
    assert abs(sum(r["target"] for r in per) - 1.5 * total) < 1e-3 * total


@pytest.mark.parametrize("sizes", [[10, 100, 100, 0], [1], [0, 0], [5, 5, 5, 5, 5, 5], [1000, 1, 2, 3, 4, 5], [1, 1000, 10, 500, 3, 77, 900], [3224, 10, 4000, 2500, 6000, 1700, 20]])
def test_source_targets(spark, sizes):
    """Against sharing and closing step by step; the last source is null."""
    names = [chr(97 + i) for i in range(len(sizes) - 1)] + [None]
    got = {r["source"]: r["target"] for r in M.source_targets(spark.createDataFrame(list(zip(names, sizes, strict=True)), "source string, source_size long")).collect()}
    weight = {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}
    size, want, left = dict(zip(names, sizes, strict=True)), {}, 1.5 * sum(sizes)
    while len(want) < len(names):
        open_ = [n for n in names if n not in want]
        level = left / sum(weight[n] for n in open_)
        over = [n for n in open_ if weight[n] * level >= 2 * size[n]]
        for n in over or open_:
            want[n] = 2 * size[n] if over else weight[n] * level
        left -= sum(want[n] for n in over)
    assert all(abs(got[n] - want[n]) < 1e-6 * (1 + want[n]) for n in names)


def sets_of(texts):
    out = []
    for t in texts:
        w = WORD.findall(bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()))
        out.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    return out


def brute_components(rows):
    sets = sets_of([r[1] for r in rows])
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
            a, b = find(i), find(j)
            if a != b:
                up[max(a, b, key=lambda k: rows[k][0])] = min(a, b, key=lambda k: rows[k][0])
    return {r[0]: (len(sets[i]), rows[find(i)][0]) for i, r in enumerate(rows)}


@pytest.mark.parametrize("hot, tile", [(N.HOT, N.TILE), (1, 4)])
def test_near_duplicates(spark, sf_dir, monkeypatch, hot, tile):
    """Also with hot keys and tiles so small that every path is taken."""
    monkeypatch.setattr(N, "HOT", hot)
    monkeypatch.setattr(N, "TILE", tile)
    rows = hard_documents(spark, sf_dir)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in N.near_duplicates(frame(spark, rows)).collect()}
    assert got == brute_components(rows)


def test_near_duplicates_random_sets(spark):
    """Small random sets around the threshold: no link may be lost."""
    random.seed(8)
    rows = []
    for g in range(40):
        base = [f"g{g}x{i}" for i in range(random.choice([5, 6, 7, 9, 12, 20, 45]))]
        for _ in range(6):
            w = [x if random.random() > 0.03 else f"r{random.randrange(10**6)}" for x in base]
            rows.append((len(rows), " ".join(w[random.randrange(2) : len(w) - random.randrange(2)]), "s"))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in N.near_duplicates(frame(spark, rows)).collect()}
    assert got == brute_components(rows)


def test_keys_share_enough():
    """Sets within the bound share more than slack published keys in some size band."""
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 5, 8, 13, 30, 80, 300):
        for _ in range(10):
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            drop = len(a) // 8
            b = np.unique(np.concatenate([a[drop:], rng.integers(0, 1 << 63, drop, dtype=np.uint64)]))
            both = len(np.intersect1d(a, b))
            if 100 * both >= 75 * (len(a) + len(b) - both):
                shared = np.intersect1d(N.keys(a, 75), N.keys(b, 75))
                assert len(shared) > min(N.banding(j, 75)[2] for j in N.bands_of(len(a), 75))
                assert N.hamming(N.sketch(a), N.sketch(b)) <= len(a) + len(b) - 2 * both


def test_near_duplicates_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert N.near_duplicates(empty).collect() == []
    df = spark.createDataFrame([(None, "a b c"), (3, "a b c"), (3, "a b c"), (4, None)], "doc_id long, text string")
    assert sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"]) for r in N.near_duplicates(df).collect()) == [(-1, 1, 3), (3, 1, 3), (3, 1, 3), (4, 0, 4)]


def test_near_duplicates_write_no_pairs_of_a_group(spark, monkeypatch):
    """Many texts of one pattern, most pairs of which are near by sketches but no links: tables of pairs don't
    grow with the square of their number, and the components are right."""
    base, made, real = [f"w{i}" for i in range(60)], [], N.shared_table
    rows = [(i, " ".join([*base[: 5 + i % 10 * 5], f"v{i}", *base[6 + i % 10 * 5 :]]), "s") for i in range(200)]
    monkeypatch.setattr(N, "shared_table", lambda df, label: made.append(real(df, label)) or made[-1])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in N.near_duplicates(frame(spark, rows)).collect()}
    assert got == brute_components(rows)
    assert max(x.count() for x in made if x.columns == ["a", "b"]) < 10 * len(rows)


@pytest.mark.parametrize("hot, tile", [(16, 512), (3, 4)])
def test_near_duplicate_links_are_all(spark, monkeypatch, hot, tile):
    """Cliques and random near copies against every pair."""
    monkeypatch.setattr(N, "HOT", hot)
    monkeypatch.setattr(N, "TILE", tile)
    random.seed(9)
    base, docs = [f"w{i}" for i in range(120)], []
    for i in range(30):
        words = list(base)
        for _ in range(random.randrange(1, 4)):
            words[random.randrange(120)] = f"v{i}x{random.randrange(99)}"
        docs.append((i, " ".join(words)))
    docs += [(100, docs[3][1]), (101, None)]
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, t in docs if t and (w := t.split(" "))}
    linked = [(a, b) for a, b in itertools.combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= N.PERCENT * len(sets[a] | sets[b])]
    near = N.NearDuplicates(spark.createDataFrame(docs, "doc_id long, text string"))
    got = sorted((r["a"], r["b"]) for r in near.links.collect())
    assert got == sorted(p for p in linked if 100 not in p) and len(got) > 60
    counts = {r["doc_id"]: r["n_links"] for r in near.link_counts().collect()}
    assert counts == {i: sum(i in p and sets[p[0]] != sets[p[1]] for p in linked) for i, _ in docs}


def test_components(spark):
    random.seed(1)
    links = [(i, i + 1) for i in range(30)] + [(100, x) for x in range(101, 130)] + [(200, 202), (202, 201), (7, 7)] + [(random.randrange(300, 400), random.randrange(300, 400)) for _ in range(80)]
    up = {}
    find = lambda x: x if up.get(x, x) == x else find(up[x])
    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for ab in links for x in ab if find(x) != x}


def test_hot_keys_are_split(spark):
    """One hub, and one set of copies, with most rows: AQE splits both joins back."""
    from stackroom.llm.components import _with_least

    small = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k, None) for k in small}
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        edges = spark.range(0, 40_000, numPartitions=8).select(F.when(F.col("id") % 4 != 0, 0).otherwise(F.col("id")).alias("u"), (F.col("id") + 1).alias("v"))
        joined = _with_least(edges)
        joined.collect()
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def brute_repeats(rows, n=100, seen=None):
    """Sorted (doc_id, n_bytes, n_removed, n_spans, kept); rows of equal order in the order given."""
    seen, out = set() if seen is None else seen, []
    for d, t in sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] is None, r[0] or 0)):
        b = (t or "").encode()
        gone = bytearray(len(b))
        end = 0
        for i in range(len(b) - n + 1):
            if b[i : i + n] in seen:
                start = max(i, end)
                gone[start : i + n] = b"\1" * (i + n - start)
                end = i + n
            seen.add(b[i : i + n])
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((d, len(b), sum(gone), sum(g and (not i or not gone[i - 1]) for i, g in enumerate(gone)), kept))
    return sorted(out, key=repr)


def removed(df):
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in df.collect()), key=repr)


MORE = [(8100, "ab" * 60, ""), (8101, "x" + "ab" * 55, ""), (8102, "\0" * 150, ""), (8103, "y" * 99, ""), (8104, "y" * 99, "")]


@pytest.mark.parametrize("hot, batch, block", [(S.HOT, S.BATCH, S.BLOCK), (1, 300, 16)])
def test_repeats(spark, sf_dir, monkeypatch, hot, batch, block):
    """Against brute force: with a very long row, null ids, and two texts and equal rows under one id."""
    monkeypatch.setattr(S, "HOT", hot)
    monkeypatch.setattr(S, "BATCH", batch)
    rows = hard_documents(spark, sf_dir, 60) + MORE
    rows += [(None, rows[5][1] + " and a text without id", ""), (9000, rows[7][1], ""), (9000, rows[7][1], ""), (9000, None, "")]
    assert removed(S.remove_repeats(frame(spark, rows))) == brute_repeats(rows)


def test_repeats_repeated_ids(spark):
    random.seed(9)
    text = lambda n: " ".join(f"{random.randrange(10**6)}" for _ in range(n))
    a, b = text(60), text(20)
    df = spark.createDataFrame([(1, a), (2, "short"), (2, a), (2, b), (3, b), (3, b)], "doc_id long, text string").coalesce(1)
    want = brute_repeats([(1, a), (2, "short"), (2, a), (2, b), (3, b), (3, b)])
    assert removed(S.remove_repeats(df)) == want and sum(x[2] for x in want) > len(a)


def test_repeats_edges(spark):
    assert S.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    df = spark.createDataFrame([(None, "z" * 200), (1, None)], "doc_id long, text string")
    assert sorted((r["doc_id"] or -1, r["n_removed"]) for r in S.remove_repeats(df).collect()) == [(-1, 199), (1, 0)]


def test_repeats_across_batches(spark, sf_dir, tmp_path, monkeypatch):
    """Later batches find the repeats of earlier ones in the stored levels."""
    rows = hard_documents(spark, sf_dir, 40) + MORE
    random.seed(3)
    random.shuffle(rows)
    index, seen, sizes = S.RepeatIndex(spark, f"file://{tmp_path}/index"), set(), []
    for part in (rows[:60], rows[60:90], [], rows[90:110], rows[110:]):
        out = index.add(spark.createDataFrame(part, "doc_id long, text string, source string"))
        assert removed(out) == brute_repeats(part, seen=seen)
        sizes.append([n.bit_length() for kind, n, _ in index.contents()[1] if kind == "level"])
    assert index.contents()[0] == 5 and all(len(set(x)) == len(x) for x in sizes) and any(sizes)


def test_repeats_of_hot_keys_are_cut_into_runs():
    """Under a frequent key, equal windows are dealt alike, and a unit's bytes are copied a few times, not once a window."""
    random.seed(12)
    line = b"a line that a very large number of documents share, each elsewhere"
    around = lambda: bytes(random.choices(b"abcdefgh ", k=150))
    texts = [around() + line + around() for _ in range(40)]
    texts += [x[:130] + x[125:] for x in texts[:10]] + [around()[:90] + x[90:] for x in texts[:10]] + [line * 5, b"z" * 150, b"xy" + line * 3]
    doc, key, _, place, n, _ = S.units(texts)
    wanted = [[{"key": int(k), "place": int(p), "windows": int(w), "hot": True} for d, k, p, w in zip(doc, key.view(np.int64), place, n, strict=True) if d == i] for i in range(len(texts))]
    kind = pa.list_(pa.struct([("key", pa.int64()), ("place", pa.int64()), ("windows", pa.int64()), ("hot", pa.bool_())]))
    batch = pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.binary()), pa.array(wanted, kind)], ["row", "doc_id", "text", "wanted"])
    rows = [r for b in S._cut(S.LENGTH, S.GRAM)(iter([batch])) for r in b.to_pylist()]
    windows, dealt = [], {}
    for r in rows:
        assert texts[r["row"]][r["place"] :].startswith(r["span"])
        for i in range(len(r["span"]) - S.LENGTH + 1):
            windows.append((r["row"], r["place"] + i))
            dealt.setdefault(r["span"][i : i + S.LENGTH], set()).add(r["key"])
    assert sorted(windows) == [(d, i) for d, t in enumerate(texts) for i in range(len(t) - S.LENGTH + 1)]
    assert all(len(keys) == 1 for keys in dealt.values()) and len(dealt) < len(windows)
    assert sum(len(r["span"]) for r in rows if r["row"] < 60) < 7 * sum(int(w) + S.LENGTH - 1 for d, w in zip(doc, n, strict=True) if d < 60)


def test_suffix_ranks():
    rng = np.random.default_rng(1)
    for length in (3, 8, 21, 100):
        text = rng.integers(97, 99, 400, dtype=np.uint8)
        cut = [bytes(text[i : i + length]).ljust(length, b"\0") for i in range(400)]
        order = {w: k for k, w in enumerate(sorted(set(cut)))}
        assert S.suffix_ranks(text, length).tolist() == [order[w] for w in cut]


def test_suffix_levels_are_geometric(monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 8)
    index = S.SuffixLevels(4)
    rng, every = np.random.default_rng(0), set()
    for _ in range(40):
        text = rng.integers(97, 100, 30, dtype=np.uint8)
        want = []
        for i in range(27):
            want.append(bytes(text[i : i + 4]) in every)
            every.add(bytes(text[i : i + 4]))
        assert index.take(text, np.arange(27)).tolist() == want
        assert all(len(v).bit_length() == k for k, v in index.levels.items())
        for v in index.levels.values():
            assert (np.sort(v.windows(0, len(v))) == v.windows(0, len(v))).all()
    assert sum(map(len, index.levels.values())) == len(every)


@pytest.fixture(scope="module")
def bpe():
    return T.public_bpe()


@pytest.fixture(scope="module")
def reference_encoding(bpe):
    import public_tokenizers as P

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={k: i for i, k in bpe.decoder.items()}, special_tokens={})


def test_bpe_equals_library(spark, sf_dir, bpe, reference_encoding):
    rows = hard_documents(spark, sf_dir, 60) + [(9101, "<|endoftext|> 's'LL don't  \n\n x\x1c\x1d　y\x85", ""), (9102, "日本語テキスト 👩‍👩‍👧 ½ ① 𝒳", ""), (9103, "ab" * 3000, "")]
    got = {r["doc_id"]: r for r in T.encode_texts(frame(spark, rows), bpe).collect()}
    for d, t, _ in rows:
        ids = reference_encoding.encode_ordinary(t or "")
        assert got[d]["ids"] == ids and got[d]["n_tokens"] == len(ids)
        assert got[d]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[d]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


def test_bpe_round_trip(spark, bpe):
    df = spark.createDataFrame([(1, "héllo wörld"), (2, None), (3, "")], "doc_id long, text string")
    assert {r["doc_id"]: bytes(r["decoded"]).decode() for r in T.decode_ids(T.encode_texts(df, bpe), bpe).collect()} == {1: "héllo wörld", 2: "", 3: ""}
    assert T.encode_texts(df.limit(0), bpe).collect() == []


def test_perfect_hash():
    keys = [f"k{i}".encode() for i in range(3000)]
    h = T.PerfectHash(keys)
    assert sorted(h.slot(k) for k in keys) == list(range(3000)) and all(keys[h.slot_key[h.slot(k)]] == k for k in keys)


def test_marginals_by_enumeration():
    rng = np.random.default_rng(2)
    trans, start = rng.normal(size=(2, 2)), rng.normal(size=2)
    lengths = [1, 4, 7, 0, 3, 9]
    first = np.cumsum([0, *lengths])
    u = rng.normal(size=first[-1]) * 2
    p, pair, head = X.marginals(u, first, trans, start)
    for lo, hi in zip(first[:-1], first[1:], strict=True):
        n, total = hi - lo, 0.0
        one, two = np.zeros(n), np.zeros((n, 2, 2))
        for y in itertools.product((0, 1), repeat=int(n)):
            if not n:
                break
            w = np.exp(start[y[0]] + sum(u[lo + k] for k in range(n) if y[k]) + sum(trans[y[k - 1], y[k]] for k in range(1, n)))
            total += w
            for k in range(n):
                one[k] += w * y[k]
                if k:
                    two[k, y[k - 1], y[k]] += w
        if n:
            assert np.allclose(p[lo:hi], one / total) and np.allclose(pair[lo + 1 : hi], two[1:] / total) and head[lo]


def toxic_rows(n=400):
    random.seed(6)
    words = [f"{a}{b}" for a in "bcdfgklm" for b in ("an", "or", "it", "el")]
    rows = []
    for i in range(n):
        w = random.choices(words, k=random.randrange(5, 60))
        bad = i % 4 == 0
        if bad:
            w.insert(random.randrange(len(w)), random.choice(["zorg", "zorgen", "zorgly,", "Nurf!"]))
        rows.append((i, " ".join(w), int(bad)))
    return rows


def test_toxicity(spark):
    rows = toxic_rows()
    docs = spark.createDataFrame([r[:2] for r in rows] + [(900, None), (901, ""), (902, "!!"), (903, "zorg " * 5), (904, "banbor " * 40000)], "doc_id long, text string").withColumns({"score": F.lit("x"), "predicted": F.lit(1)})
    labels = spark.createDataFrame([(r[0], 1, r[2]) for r in rows], "doc_id long, quality int, toxic int")
    out = {r["doc_id"]: r for r in X.score_toxicity(docs, X.learn(docs, labels)).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert {i for i, r in out.items() if i < 900 and r["held_out"]} == {r[0] for r in held}
    assert sum(out[i]["predicted"] == y for i, _, y in held) / len(held) > 0.97
    assert [out[i]["score"] for i in (900, 901, 902)] == [0.0] * 3 and out[903]["predicted"] == 1 and out[904]["predicted"] == 0
    text = dict(r[:2] for r in rows)
    spans = {text[i][s["from"] : s["to"]].lower() for i, r in out.items() if i in text for s in r["spans"]}
    assert spans and spans <= {"zorg", "zorgen", "zorgly", "nurf"}


def test_document_scores_by_enumeration():
    """Scores and spans of short texts against the sum over all taggings."""
    rows = toxic_rows(160)
    model = X.ToxicityModel.calibrated([t.encode() for _, t, _ in rows], [y for *_, y in rows])
    texts = ["zorg ban", "", "é zorg, nurf lan!", "ban bor bit", "Nurf!", "-- zorgen - mit kel zorg dan"]
    scores, spans = model.score([t.encode() for t in texts])
    for text, score, found in zip(texts, scores, spans, strict=True):
        u = model.potentials(X.tokens([text.encode()])["features"])
        total, one = 0.0, np.zeros(len(u))
        for y in itertools.product((0, 1), repeat=len(u)):
            w = np.exp(sum(model.start[y[k]] if k == 0 else model.trans[y[k - 1], y[k]] for k in range(len(y))) + u @ np.array(y)) if y else 1.0
            total += w
            one += w * np.array(y)
        p = one / total
        assert abs(score - (1 - np.exp(-model.rate * (p**model.power).sum()))) < 1e-6
        words = [m.span() for m in re.finditer(r"[0-9A-Za-z\u0080-\U0010ffff]+", text)]
        assert [(s["from"], s["to"]) for s in found] == [x for x, q in zip(words, p, strict=True) if q >= X.SPAN_AT]
    assert scores[0] >= X.THRESHOLD > scores[3]


def test_best_cut():
    sums, toxic = np.array([0.0, 0.0, 0.1, 0.4, 0.9]), np.array([0, 0, 0, 1, 1])
    assert X.best_cut(sums, toxic) == (1.0, pytest.approx(0.25))


def test_toxicity_sample_is_bounded(spark):
    rows = toxic_rows(80)
    docs = spark.createDataFrame([r[:2] for r in rows] + [(1, "a a"), (1, "a a"), (None, "x"), (0, "long " * 5000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(None, 1, 1), (2, 1, None), (4, 1, 0), (4, 1, 1)], "doc_id long, quality int, toxic int")
    seen = []
    real = X.ToxicityModel.calibrated
    try:
        X.ToxicityModel.calibrated = classmethod(lambda cls, texts, toxic: seen.append((texts, toxic)) or real(texts, toxic))
        X.learn(docs, labels, max_toxic=9, max_clean=12, max_bytes=64 * 400)
    finally:
        X.ToxicityModel.calibrated = real
    texts, toxic = seen[0]
    assert 0 < sum(toxic) <= 9 and 0 < len(toxic) - sum(toxic) <= 12 and max(map(len, texts)) <= 400 and sum(map(len, texts)) <= 64 * 400


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = X.learn(docs, none)
    assert X.score_toxicity(docs, model).first()["predicted"] == 0 and X.score_toxicity(docs.limit(0), model).collect() == []
    assert X.drop_toxic(docs, model).columns == docs.columns


def test_labels_of_held_out_rows_do_not_matter(spark):
    rows = toxic_rows(120)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    flipped = [(i, 1, 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, _, y in rows]
    a = X.learn(docs, spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int"))
    b = X.learn(docs, spark.createDataFrame(flipped, "doc_id long, quality int, toxic int"))
    assert np.array_equal(a.weights, b.weights)


def test_pipeline(spark, sf_dir, reference_encoding):
    """Each stage against brute force on its own input."""
    import corpus_pipeline as P
    from stackroom.llm.common import shared_table

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    stages = dict(P.STAGES)
    rows = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}

    clean = shared_table(stages["toxicity"](spark, docs, sf_dir), "t1")
    model = X.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    all_rows = rows(docs)
    scores = dict(zip(all_rows, model.score([t.encode() for t in all_rows.values()])[0], strict=True))
    assert set(rows(clean)) == {i for i, s in scores.items() if s < X.THRESHOLD} and clean.columns == columns

    single = shared_table(stages["exact dedup"](spark, clean, sf_dir), "t2")
    first = {}
    for i, t in sorted(rows(clean).items()):
        first.setdefault(re.sub(r"[ \t-\r]+", " ", t), i)
    assert set(rows(single)) == set(first.values()) and sorted(single.columns) == sorted(columns)

    apart = shared_table(stages["n-gram Jaccard join"](spark, single, sf_dir), "t3")
    want = brute_components([(i, t) for i, t in rows(single).items()])
    assert set(rows(apart)) == {i for i, (_, c) in want.items() if c == i}

    mixed = shared_table(stages["mixing sources to target weights"](spark, apart, sf_dir), "t4")
    copies = {r["doc_id"]: r["copies"] for r in M.mix_sources(apart).collect()}
    got = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert got == {i: c for i, c in copies.items() if c}

    last = stages["byte-level BPE encoding and decoding"](spark, mixed, sf_dir).collect()
    text = rows(mixed)
    assert len(last) == mixed.count() and all(r["n_tokens"] == len(reference_encoding.encode_ordinary(text[r["doc_id"]])) for r in last)
    assert sorted(map(tuple, P.run(spark, sf_dir).collect())) == sorted(map(tuple, last))


def test_pipeline_null_and_repeated_ids(spark, sf_dir):
    """Decisions hold per row: null ids are judged by their texts, repeated rows leave one."""
    import corpus_pipeline as P

    text = lambda k: " ".join(f"t{k}w{i}" for i in range(40))
    rows = [(None, text(0)), (None, text(1)), (None, text(2)), (2, text(2)), (None, text(3)), (None, text(3)), (7, text(8)), (7, text(9))] + [(5, text(4))] * 30
    near = [(None, text(5)), (9, text(5) + " more"), (None, text(6)), (None, text(6) + " more"), (6, text(7)), (6, text(7) + " more")]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows + near], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    stages, seen = dict(P.STAGES), lambda df: sorted(((r["doc_id"] or 0, r["text"]) for r in df.collect()))
    single = stages["exact dedup"](spark, docs, sf_dir)
    want = [(0, text(0)), (0, text(1)), (2, text(2)), (0, text(3)), (7, text(8)), (7, text(9)), (5, text(4))]
    assert seen(single) == sorted(want + [(i or 0, t) for i, t in near]) and single.columns == docs.columns
    apart = stages["n-gram Jaccard join"](spark, docs, sf_dir)
    found = seen(apart)
    assert len(found) == len(want) + 3 and set(want) <= set(found) and (9, text(5) + " more") in found
    assert {t.split(" ")[0] for i, t in found if (i, t) not in want} == {"t5w0", "t6w0", "t7w0"}
    mixed = stages["mixing sources to target weights"](spark, docs, sf_dir)
    copies = sum(r["copies"] for r in M.mix_sources(docs).collect())
    assert mixed.count() == copies > 0 and mixed.columns == docs.columns
