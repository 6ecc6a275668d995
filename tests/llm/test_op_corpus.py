"""Operators over a whole corpus, against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from lakelens.llm import components, decontamination, quality_mil, sharding, simhash, suffix_dedup
from tests.conftest import SMALL, TINY
from tests.llm.test_op_texts import ODD, odd, texts


def test_op4_equals_brute_force(spark):
    rows, sums = sorted(texts(spark).items()), 0
    total = sum(len(t.encode()) + 8 for _, t in rows)
    got = {r["doc_id"]: r for r in sharding.op4_byte_shards(spark, TINY).collect()}
    slots: Counter = Counter()
    for i, text in rows:
        size = len(text.encode()) + 8
        shard = min(23, int((sums + size / 2) * 24 // total))
        want = (size, zlib.crc32(text.encode()), "bytes", shard, slots[shard], None)
        assert tuple(got[i][c] for c in ("size", "text_crc32", "law", "shard", "slot", "grown_shard")) == want
        slots[shard] += 1
        sums += size


def test_op4_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    found = con.execute(sharding.OP4_SQL)
    columns = [d[0] for d in found.description]
    assert sorted(found.fetchall()) == sorted(map(tuple, sharding.op4_byte_shards(spark, SMALL).select(*columns).collect()))


def test_op4_odd_rows(spark):
    got = sharding.shard_by_bytes(odd(spark), 3).collect()
    assert len(got) == len(ODD) and min(r["size"] for r in got) == 8
    for shard in {r["shard"] for r in got}:
        slots = sorted(r["slot"] for r in got if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    assert sharding.shard_by_bytes(odd(spark).filter("false"), 3).isEmpty()


def brute_spans(documents):
    """(n_bytes, n_removed, n_spans, kept sha256) of each text."""
    seen: Counter = Counter()
    for b in documents:
        seen.update(b[i : i + 200] for i in range(len(b) - 199))
    out = []
    for b in documents:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                gone[i : i + 200] = True
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def passages_corpus(seed):
    """Texts with shared passages of lengths about the limit, periodic stretches and copies."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randint(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))[: n * 5]
    shared = [text(60)[:k] for k in (199, 200, 201, 230, 290)]
    rows = [text(rng.randint(0, 120)) + rng.choice(["", *shared]) + text(rng.randint(0, 40)) + rng.choice(["", *shared]) for _ in range(60)]
    return [*rows, "ab" * 300, "x" * 199, "x" * 200, "y" * 201, "", text(70), rows[0], rows[0], "z" * 450 + shared[3], None]


@pytest.mark.parametrize("seed,hot", [(1, 5000), (2, 1)])
def test_op5_equals_brute_force(spark, monkeypatch, seed, hot):
    monkeypatch.setattr(suffix_dedup, "HOT_CORE", hot)
    monkeypatch.setattr(suffix_dedup, "BATCH_SUFFIXES", 500)
    corpus = passages_corpus(seed)
    corpus += [corpus[k % 60][: 50 + k] + " " + corpus[3][-280:] for k in range(90)]  # a passage that many texts share
    docs = spark.createDataFrame(list(enumerate(corpus)), "doc_id long, text string")
    for dealt in (docs, docs.coalesce(1), docs.filter("doc_id < 30").unionByName(docs.filter("doc_id >= 30").coalesce(1))):
        got = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.remove_repeats(dealt, "sha2(kept, 256)").drop("rest").collect()}
        assert got == dict(enumerate(brute_spans([(t or "").encode() for t in corpus])))


def test_op5_hot_cores_are_marked():
    """A passage in many texts of a batch: its runs are salted by context, with one mark for the core."""
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    shared = word(300)
    rows = [(i, i, (word(100 + i) + shared + word(100)).encode()) for i in range(60)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["rep", "c1", "bytes"])
    got = pa.Table.from_batches(suffix_dedup.map_anchors(iter([batch]))).to_pylist()
    marked = [r["core"] for r in got if r["kind"] == suffix_dedup.MARK]
    assert marked and len(set(marked)) == len(marked) and all(r["salt"] == 0 for r in got if r["kind"] != suffix_dedup.RUN)
    assert all((r["salt"] > 0) == (r["core"] in marked) for r in got if r["kind"] == suffix_dedup.RUN)
    assert len({r["salt"] for r in got}) > 10


def test_op5_query(spark):
    want = texts(spark)
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.op5_suffix_dedup(spark, TINY).collect()}
    assert got == dict(zip(want, brute_spans([t.encode() for t in want.values()]), strict=True))


def test_op5_family_in_batches():
    """Bytes decide, also where routes are equal by chance; levels are sorted by bytes and grow geometrically."""
    rng = np.random.default_rng(0)
    stock = [rng.integers(97, 99, 200).astype(np.uint8).tobytes() for _ in range(700)]
    stock += [s[:k] + bytes([s[k] ^ 1]) + s[k + 1 :] for s in stock[:300] for k in (199,)]
    which = rng.integers(0, len(stock), 1500)
    family, told = suffix_dedup.SuffixFamily(), []
    for part in np.array_split(which, 23):
        at, route = np.arange(len(part)) * 200, (part % 300 % 7).astype(np.uint64)  # few routes, so most are shared
        told += family.add(suffix_dedup.Suffixes(b"".join(stock[k] for k in part), at, route)).tolist()
    counts = Counter(which.tolist())
    assert sorted(told) == [i for i, k in enumerate(which.tolist()) if counts[k] > 1]
    assert all(len(a.owner) >= 2 * len(b.owner) for a, b in zip(family.levels, family.levels[1:], strict=False))
    for level in family.levels:
        s = level.suffixes
        rows = [(r, s.data[a : a + 200]) for r, a in zip(s.route.tolist(), s.at.tolist(), strict=True)]
        assert rows == sorted(rows) and len(set(rows)) == len(rows)


def test_op5_bytes_decide(monkeypatch):
    """Runs with one core hash are told apart by bytes, and matches between batches come from the scans of the levels."""
    schema = pa.schema([("part", pa.int64()), ("core", pa.int64()), ("rep", pa.int64()), ("c1", pa.int64()), ("begin", pa.int64()), ("ahead", pa.int32()), ("bytes", pa.binary())])
    same, other = b"q" * 100 + b"r" * 110, b"q" * 100 + b"r" * 99 + b"s" * 11
    rows = [(1, 1, i, i, 50, 20, b) for i, b in enumerate([same, other, same])]
    batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
    spans = lambda: sorted(tuple(r.values()) for out in suffix_dedup.map_families(iter([batch])) for r in out.to_pylist())
    want = [(0, 0, 50, 260), (2, 2, 50, 260)]
    assert spans() == want
    monkeypatch.setattr(suffix_dedup, "BATCH_SUFFIXES", 1)
    assert spans() == want
    monkeypatch.setattr(suffix_dedup, "compare", lambda a, i, b, j: np.ones(len(i), np.int8))
    assert spans() == []


@pytest.mark.parametrize("seed", [1, 2])
def test_op5_pieces_of_a_long_text(monkeypatch, seed):
    rng = random.Random(seed)
    data = "".join(rng.choice("abcd ") for _ in range(6000)).encode() + b"x" * 1500 + b"ab" * 800
    whole = [np.concatenate(c) for c in zip(*suffix_dedup.anchors(data), strict=True)]
    monkeypatch.setattr(suffix_dedup, "PIECE", 1100)
    pieces = [np.concatenate(c) for c in zip(*suffix_dedup.anchors(data), strict=True)]
    assert all((a == b).all() for a, b in zip(whole, pieces, strict=True))


def test_op5_odd_rows(spark):
    got = suffix_dedup.remove_repeats(odd(spark)).collect()
    assert len(got) == len(ODD) and sum(r["doc_id"] is None for r in got) == 1
    assert suffix_dedup.remove_repeats(odd(spark).filter("false")).isEmpty()


def words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def brute_contamination(documents, items):
    out = {}
    for item_id, item in items:
        b = words(item)
        want = Counter(zip(*[b[k:] for k in range(5)], strict=False))
        for doc_id, text in documents:
            w = words(text)
            grams = list(zip(*[w[k:] for k in range(5)], strict=False)) if len(w) >= 5 else []
            m = min(want.total(), len(grams))
            if not m or not want or not set(want) & set(grams):
                continue
            best = 0.0
            for i in range(len(grams) - m + 1):
                both = (Counter(grams[i : i + m]) & want).total()
                best = max(best, both / (m + want.total() - both))
            if best >= 0.8:
                out[doc_id, item_id] = round(best, 6)
    return out


def test_op6_equals_brute_force(spark):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{TINY}/benchmark.parquet").collect()]
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontamination.op6_decontamination(spark, TINY).collect()}
    assert got == brute_contamination(list(texts(spark).items()), items) and got


def test_op6_edited_passages_and_odd_rows(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    item = [rng.choice(vocabulary) for _ in range(80)]
    bed = lambda n: [rng.choice(vocabulary) + "x" for _ in range(n)]
    edited = list(item)
    edited[40] = "changed"
    docs = [(1, bed(50) + item + bed(50)), (2, bed(50) + edited + bed(10)), (3, bed(20) + item[:40] + bed(90)), (4, item[2:]), (5, bed(30) + item + bed(3) + item), (6, bed(200)), (7, [w.upper() + "," for w in item]), (8, item[:3])]
    frame = spark.createDataFrame([(i, " ".join(w)) for i, w in docs] + [(None, " ".join(item)), (9, None), (10, "")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(item)), (2, "too short"), (3, None), (1, " ".join(item))], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontamination.contaminated(frame, bench).collect()}
    want = brute_contamination([(i, " ".join(w)) for i, w in docs], [(1, " ".join(item))])
    assert {k: v for k, v in got.items() if k[0] is not None} == want and (None, 1) in got
    assert {k[0] for k in want} == {1, 2, 4, 5, 7}
    kept = decontamination.without_contaminated(frame, bench)
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 6, 8, 9, 10]
    assert decontamination.contaminated(frame.filter("false"), bench).isEmpty()
    assert decontamination.contaminated(frame, bench.filter("false")).isEmpty()


def edited(rng, words, share):
    """The words with some of them changed, so that about ``share`` of the shingles stay."""
    out = list(words)
    for k in rng.sample(range(len(out)), max(0, round(len(out) * (1 - share) / 5.5))):
        out[k] = f"z{rng.randrange(10**6)}"
    return out


def test_op6_recall_on_edits(spark):
    """Edited passages about the limit: as many pairs as brute force finds, each proposed by the Hamming index."""
    rng = random.Random(11)
    items = [[f"v{int(rng.paretovariate(0.7)) % 900}" for _ in range(rng.randint(13, 160))] for _ in range(150)]
    docs = []
    for k, item in enumerate(items):
        for share in (0.85, 0.9, 0.95):
            docs.append((len(docs), " ".join([f"x{rng.randrange(10**6)}" for _ in range(30)] + edited(rng, item, share) + items[k - 1][:9])))
    bench = [(k, " ".join(w)) for k, w in enumerate(items)]
    want = brute_contamination(docs, bench)
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    rows = decontamination.contaminated(*frames).collect()
    assert {(r["doc_id"], r["item_id"]): r["similarity"] for r in rows} == want and len(want) > 200
    assert sum(s < 0.85 for s in want.values()) > 40 and max(r["distance"] for r in rows) <= decontamination.RADIUS


def test_op6_index_does_the_search(spark, monkeypatch):
    frames = spark.createDataFrame([(1, "a b c d e f g h i j k")], "doc_id long, text string"), spark.createDataFrame([(1, "a b c d e f g h i j k")], "item_id long, text string")
    assert decontamination.contaminated(*frames).count() == 1
    monkeypatch.setattr(decontamination, "near_values", lambda block: [1 << 40])
    assert decontamination.contaminated(*frames).isEmpty()


def test_op6_blocks_reach_the_radius():
    """Any two fingerprints within the radius agree in a block up to FLIPS bits."""
    rng = random.Random(2)
    for _ in range(2000):
        change = sum(1 << b for b in rng.sample(range(64), decontamination.RADIUS))
        assert any((change >> at & (1 << width) - 1) in decontamination.near_values((at, width)) for at, width in decontamination.BLOCKS)


def test_op6_is_native(spark):
    plan = decontamination.contaminated(odd(spark), spark.read.parquet(f"{TINY}/benchmark.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def slow_fingerprint(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [" ".join(w)] if 0 < len(w) < 4 else [" ".join(w[i : i + 4]) for i in range(len(w) - 3)]
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, prints, radius=4):
    parent = list(range(len(ids)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    values = np.array(prints, np.uint64)
    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(values ^ values[i]) <= radius).tolist():
            a, b = root(i), root(j)
            parent[max(a, b)] = min(a, b)
    least: dict = {}
    for i, d in enumerate(ids):
        least[root(i)] = min(least.get(root(i), 1 << 62), d)
    return [least[root(i)] for i in range(len(ids))]


def test_op9_equals_brute_force(spark):
    want = texts(spark, SMALL)
    prints = [slow_fingerprint(t) for t in want.values()]
    groups = brute_components(list(want), prints)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.op9_simhash_near_dedup(spark, SMALL).collect()}
    assert got == {i: (f"{p:016x}", c) for i, p, c in zip(want, prints, groups, strict=True)}


def test_op9_tiles_and_chains(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 64)
    rng = random.Random(4)
    values = [rng.getrandbits(64) for _ in range(250)]
    for _ in range(250):  # chains of near values
        values.append(values[rng.randrange(len(values))] ^ sum(1 << rng.randrange(64) for _ in range(4)))
    values = sorted(set(values))
    frame = spark.createDataFrame([(simhash.signed(v),) for v in values], "fp long")
    roots = {r["node"]: r["root"] for r in components.connected_components(simhash.link_forests(frame)).collect()}
    want = brute_components(list(range(len(values))), values)
    mine: dict = {}
    for v, c in zip(values, want, strict=True):
        mine.setdefault(roots.get(simhash.signed(v), simhash.signed(v)), set()).add(c)
    assert all(len(c) == 1 for c in mine.values()) and len(mine) == len(set(want))


def test_op9_odd_rows(spark):
    got = simhash.near_duplicates(odd(spark)).collect()
    assert len(got) == len(ODD) and {r["fp"] for r in got if r["doc_id"] in (1, 2, 3)} == {0}
    assert {r["component_id"] for r in got if r["doc_id"] in (1, 2, 3)} == {1}
    assert simhash.near_duplicates(odd(spark).filter("false")).isEmpty()
    kept = simhash.one_of_each(odd(spark))
    assert kept.columns == odd(spark).columns and sorted(r["doc_id"] for r in kept.filter("doc_id is not null").collect()) == [1, 5, 6, 7]


def test_op9_similar_texts_stay_once(spark):
    rng = random.Random(6)
    base = [f"word{rng.randrange(5000)}" for _ in range(300)]
    near = list(base)
    for k in (20, 150, 280):
        near[k] = "other"
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(base)), (4, " ".join(reversed(base)))]
    kept = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 4]


def brute_stays(rows):
    """doc_ids that stay if links are exact Jaccard similarities of 0.8 of five-word shingle sets."""
    sets = {}
    for i, text in rows:
        w = text.encode().lower().split()
        sets[i] = {b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    root = {i: i for i, _ in rows}
    for a in sorted(sets):
        for b in sorted(sets):
            size = min(len(sets[a]), len(sets[b])) / max(len(sets[a]), len(sets[b]))
            if b > a and root[a] != root[b] and size >= 0.8 and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                low, high = sorted((root[a], root[b]))
                root = {k: low if v == high else v for k, v in root.items()}
    return sorted(set(root.values()))


def test_pipeline_near_dedup_equals_brute_force(spark, monkeypatch):
    """Repeated lines link nothing, and pairs about a similarity of 0.8 are decided exactly; in one tile and in many."""
    rng = random.Random(8)
    prose = lambda n: [f"word{rng.randrange(5000)}" for _ in range(n)]
    line = prose(13)
    texts_ = [prose(304) + line * 20, prose(304) + line * 20, prose(1000) + line * 50]
    for n in (8, 9, 40, 150, 300):
        for changes in (*range(1, 10), 12, 15):
            base = prose(n)
            near = list(base)
            for k in rng.sample(range(n), min(n, changes)):
                near[k] = "other"
            texts_ += [base, near, base[: n - changes] if n > changes else base]
    chain = prose(200)
    for k in range(12):
        texts_.append([*chain])
        chain[k * 16] = f"new{k}"
    rows = list(enumerate(map(" ".join, texts_)))
    want = brute_stays(rows)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    kept = lambda: sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, frame, TINY).collect())
    assert kept() == want and {0, 1, 2} <= set(want) and len(want) < len(rows)
    monkeypatch.setattr(simhash, "SETS", 2)
    assert kept() == want


def test_pipeline_near_dedup_on_documents(spark):
    rows = sorted(texts(spark).items())
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, frame, TINY).collect()) == brute_stays(rows)


def test_components_of_a_path_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, i) for i in range(1001, 1100)] + [(5000, 5000)]
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {got[i] for i in range(61)} == {0} and {got[i] for i in range(1000, 1100)} == {1000} and 5000 not in got


def test_pipeline_stages(spark, tmp_path):
    """Each stage on its own input, against what the operators' definitions demand of it."""
    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, TINY).write.parquet(f"{tmp_path}/{name}")
        after = spark.read.parquet(f"{tmp_path}/{name}")
        ids = {r["doc_id"] for r in after.select("doc_id").collect()}
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert ids <= set(before)
        if name != "tokens":
            assert after.columns == columns
        if name == "repeated_passages":
            cut = {r["doc_id"]: r["text"] for r in after.collect()}
            removed = dict(zip(before, brute_spans([t.encode() for t in before.values()]), strict=True))
            assert all(cut[i] == before[i] for i in cut if removed[i][1] == 0)
            assert all(len(cut[i].encode()) <= removed[i][0] - removed[i][1] for i in cut)
            assert after.filter("n_chars <> length(text)").isEmpty() or all(removed[r["doc_id"]][1] == 0 for r in after.filter("n_chars <> length(text)").collect())
        if name == "decontaminate":
            items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{TINY}/benchmark.parquet").collect()]
            assert set(before) - ids == {d for d, _ in brute_contamination(list(before.items()), items)}
        if name == "tokens":
            assert ids == set(before)
            assert {r["doc_id"]: r["decoded_sha256"] for r in after.collect()} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in before.items()}
        docs = after


def test_pipeline_run_and_extra_columns(spark):
    assert corpus_pipeline.run(spark, TINY).count() > 50
    docs = odd(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, TINY)
        assert docs.columns == odd(spark).columns, name
        assert all(r is not None for r in docs.collect())
    assert F is not None


def test_pipeline_stages_keep_columns_of_any_name(spark):
    names = ["a.b", "__bad_id", "__bad_th", "__stay_id", "__stay_th", "c0", "c3", "one_id", "row", "a b`c", "TEXT2"]
    docs = spark.createDataFrame([r[:2] for r in ODD], "doc_id long, text string").select(F.lit(7).alias(names[0]), "doc_id", *(F.lit(i).alias(c) for i, c in enumerate(names[1:])), "text")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, TINY)
        assert got.columns == docs.columns and all(r[0] == 7 and r[2] == 0 for r in got.collect()), name
    assert corpus_pipeline.tokens(spark, docs, TINY).count() == len(ODD)


def test_pipeline_stages_on_empty_tables_and_odd_rows(spark):
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, odd(spark).filter("false"), TINY)
        assert empty.isEmpty() and (name == "tokens" or empty.columns == odd(spark).columns)
    rows = {name: stage(spark, odd(spark), TINY).collect() for name, stage in corpus_pipeline.STAGES[1:]}
    assert len(rows["decontaminate"]) == len(rows["tokens"]) == len(ODD)
    assert sorted(r["doc_id"] for r in rows["near_dedup"] if r["doc_id"] is not None) == [1, 5, 6, 7]
    assert {r["doc_id"] for r in rows["repeated_passages"]} == {None, 5, 7}  # the long text repeats itself throughout


def test_pipeline_run_on_empty_documents_and_again(spark, tmp_path):
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{TINY}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    docs.filter("false").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).isEmpty()
    want = corpus_pipeline.run(spark, TINY, f"{tmp_path}/work").count()
    (tmp_path / "work" / "tokens" / "_SUCCESS").unlink()  # a run that was lost in its last stage
    again = corpus_pipeline.run(spark, TINY, f"{tmp_path}/work")
    assert again.count() == want


def test_pipeline_quality_equals_the_model(spark):
    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    model = quality_mil.quality_model(docs, spark.read.parquet(f"{TINY}/labels.parquet"))
    want = sorted(i for i, t in texts(spark).items() if slow_score(model, t.encode()) >= 0.5)
    assert sorted(r["doc_id"] for r in corpus_pipeline.quality(spark, docs, TINY).collect()) == want


def slow_score(model, text):
    """The model's formula, passage by passage."""
    x = (quality_mil.passages([text])[0] - model.mean) / model.scale
    p = model.p
    h = [np.tanh(row @ p["W"] + p["b"]) for row in x]
    e = [(np.tanh(v @ p["V"]) / (1 + np.exp(-(v @ p["U"])))) @ p["w"] for v in h]
    a = np.exp(np.array(e) - max(e))
    z = sum(w * v for w, v in zip(a / a.sum(), h, strict=True))
    return float(1 / (1 + np.exp(-(z @ p["c"] + p["c0"][0]))))


def test_pipeline_keeps_characters_whole(spark):
    """Replacement characters of the source stay; a character of which a part is removed goes whole."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    body = " ".join(word() for _ in range(60))
    rows = [(1, "start \ufffd mark \u00e9" + body + "\u00e9 end \ufffd"), (2, "other \u00ea" + body + "\u00e8 stop"), (3, "clean \ufffd\ufffd text")]
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.repeated_passages(spark, spark.createDataFrame(rows, "doc_id long, text string"), TINY).collect()}
    # the first bytes of the four letters are equal, and so are the passages' ends
    assert got[3] == "clean \ufffd\ufffd text"
    assert got[1] == "start \ufffd mark \u00e9 end \ufffd" or got[1] == "start \ufffd mark  end \ufffd"
    assert got[2] == "other \u00ea stop" or got[2] == "other  stop"
    assert suffix_dedup.to_characters("a\u00e9b".encode(), 2, 2) == (1, 3) and suffix_dedup.to_characters(b"abc", 1, 2) == (1, 2)
