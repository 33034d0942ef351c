"""Exact, near and substring duplicates, leaks and shards against brute force on small tables."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from ravenna.llm import _rows, decontaminate, exact_dedup, near_dedup, sharding, substring_dedup
from ravenna.llm.components import components

SCHEMA = "doc_id long, text string, name string, rep string"
VOCABULARY = [f"w{i}" for i in range(300)]


def some_texts(seed: int = 5, n: int = 60) -> list[tuple]:
    """Random texts with copies, near copies, shared passages, and odd ones."""
    rng = random.Random(seed)
    texts = [" ".join(rng.choices(VOCABULARY, k=rng.randint(1, 150))) for _ in range(n)]
    passage = rng.choices(VOCABULARY, k=60)
    for _ in range(12):
        words = rng.choice(texts).split()
        at = rng.randrange(len(words))
        texts.append(" ".join(words[:at] + passage[: rng.randint(30, 60)] + words[at:]))
    for _ in range(40):
        words = rng.choice(texts[:20]).split()
        for _ in range(rng.randint(0, 1 + len(words) // 12)):
            words[rng.randrange(len(words))] = rng.choice(VOCABULARY)
        texts.append(" ".join(words))
    texts += [None, None, "", "", " \t", "one", "ONE", "one", "a  b\n\nc", "a b c ", " ".join(["again"] * 80), " ".join(passage), " ".join(passage)]
    return [(i, t, "x", "y") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(some_texts(), SCHEMA)


@pytest.fixture(scope="module")
def texts():
    return {i: t or "" for i, t, _, _ in some_texts()}


def odd_rows(spark):
    """Repeated rows, repeated ids, null ids."""
    return spark.createDataFrame([(1, "a b c d", "", ""), (1, "a b c d", "", ""), (1, "e f g h", "", ""), (None, "a b c d", "", ""), (None, None, "", ""), (2, None, "", "")], SCHEMA)


@pytest.mark.parametrize("block", [7, 64, 8192])
def test_exact_dedup_is_grouping_by_text(docs, texts, block):
    plain = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t) for i, t in texts.items()}
    groups = defaultdict(list)
    for i, t in plain.items():
        groups[t].append(i)
    for r in exact_dedup.exact_dedup(docs, block_chars=block).collect():
        own = groups[plain[r.doc_id]]
        assert (r.keep_id, r.group_size, r.kept) == (min(own), len(own), r.doc_id == min(own))
        assert r.text_sha256 == hashlib.sha256(plain[r.doc_id].encode()).hexdigest()


def test_exact_dedup_odd_rows(spark):
    rows = exact_dedup.exact_dedup(odd_rows(spark)).collect()
    assert len(rows) == 6
    same = [r for r in rows if r.group_size == 3]
    assert {r.keep_id for r in same} == {1} and sum(r.kept for r in same) == 1 and next(r for r in same if r.kept).doc_id == 1
    assert {(r.doc_id, r.keep_id, r.kept) for r in rows if r.group_size == 2} == {(None, 2, False), (2, 2, True)}
    assert exact_dedup.exact_dedup(odd_rows(spark).limit(0)).count() == 0


def test_drop_copies_keeps_the_columns(docs):
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    assert kept.count() == exact_dedup.exact_dedup(docs).where("kept").count()


def brute_components(texts: dict, size: int, percent: int) -> dict:
    sets = {i: near_dedup.shingles(near_dedup.words_of(t), size) for i, t in texts.items()}
    root = {i: i for i in texts}

    def of(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in texts:
        for j in texts:
            if j < i and near_dedup.linked(sets[i], sets[j], percent):
                a, b = sorted((of(i), of(j)))
                root[b] = a
    return {i: of(i) for i in texts}


@pytest.mark.parametrize("size,rounds", [(2, 3), (2, 0), (5, 1)])
def test_near_dedup_finds_all_components(docs, texts, size, rounds, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 3)
    want = brute_components(texts, size, 80)
    assert len(set(want.values())) < len(want) - 10
    for r in near_dedup.near_dedup(docs, size, 80, rounds).collect():
        assert (r.component_id, r.kept) == (want[r.doc_id], r.doc_id == want[r.doc_id])
        assert r.n_shingles == len(near_dedup.shingles(near_dedup.words_of(texts[r.doc_id]), size))


def test_near_dedup_query_against_brute_force(spark, small):
    from ravenna.llm import queries

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    want = brute_components(texts, 2, 80)
    assert {r.doc_id: r.component_id for r in queries.op4_minmax_near_dedup(spark, small).collect()} == want


def test_near_dedup_odd_rows(spark):
    rows = near_dedup.near_dedup(odd_rows(spark), 2).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0, r.kept) for r in rows) == [(0, 0, 0, True), (0, 3, 0, True), (1, 3, 1, True), (1, 3, 1, True), (1, 3, 1, True), (2, 0, 2, True)]
    assert near_dedup.near_dedup(odd_rows(spark).limit(0)).count() == 0


def test_signature_estimates_similarity():
    rng = random.Random(1)
    signer = near_dedup.Signer(2)
    words = [w.encode() for w in rng.choices(VOCABULARY, k=400)]
    other = words[:360] + [w.encode() for w in rng.choices(VOCABULARY, k=40)]
    a, b = near_dedup.shingles(words, 2), near_dedup.shingles(other, 2)
    x, y = (signer.signature(signer.shingle_hashes(w)) for w in (words, other))
    share = sum(p == q for p, q in zip(x, y, strict=True)) / len(x)
    assert abs(near_dedup.similarity(np.array(share)) - len(a & b) / len(a | b)) < 0.15


def test_signature_is_unbiased():
    """Of many pairs of sets the mean error is far below one pair's spread, for distant sets too."""
    rng = np.random.default_rng(3)
    signer, errors = near_dedup.Signer(2), {0.0: [], 0.5: [], 0.8: []}
    for like, found in errors.items():
        for _ in range(120):
            both = rng.integers(0, 1 << 63, int(like * 300), np.uint64)
            own = [np.concatenate([both, rng.integers(0, 1 << 63, (300 - len(both)) // 2, np.uint64)]) for _ in range(2)]
            a, b = (np.frombuffer(signer.signature(np.unique(x)), np.uint8) for x in own)
            found.append(near_dedup.similarity((a == b).mean()) - len(both) / (2 * len(own[0]) - len(both)))
    assert all(abs(np.mean(e)) < 0.008 for e in errors.values())


def test_one_bucket_of_many_similar_rows_that_are_not_linked(spark, monkeypatch):
    """All classes in one bucket, in many blocks: every pair of blocks is a row of its own, and no link is lost."""
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    monkeypatch.setattr(near_dedup, "TEXT_BLOCK", 4000)
    monkeypatch.setattr(near_dedup, "ROWS", 1)
    monkeypatch.setattr(near_dedup, "BANDS", 200)
    rng = random.Random(8)
    common = [f"c{i}" for i in range(60)]
    texts = {i: " ".join(common[:30] + rng.choices(VOCABULARY, k=30) + common[30:]) for i in range(90)}
    texts |= {100 + i: texts[i] + " more" for i in range(0, 90, 9)}
    want = brute_components(texts, 2, 80)
    assert len(set(want.values())) == 90
    got = near_dedup.near_dedup(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), 2, 80, 0)
    assert {r.doc_id: r.component_id for r in got.collect()} == want


def test_hot_keys_are_joined_by_broadcast(spark, docs, texts, monkeypatch):
    """With every key counted as hot, results are the same."""
    monkeypatch.setattr(_rows, "HOT_ROWS", 1)
    monkeypatch.setattr(near_dedup, "HOT_ROWS", 1)
    assert {r.doc_id: r.component_id for r in near_dedup.near_dedup(docs, 2, 80, 2).collect()} == brute_components(texts, 2, 80)
    plain = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t) for i, t in texts.items()}
    assert all(r.keep_id == min(i for i in plain if plain[i] == plain[r.doc_id]) for r in exact_dedup.exact_dedup(docs).collect())
    want = brute_removed(texts)
    assert all(r.n_words - r.n_removed == len(want[r.doc_id]) for r in substring_dedup.substring_dedup(docs).collect())
    edges = [(i, i + 1) for i in range(20)] + [(100, i) for i in range(101, 140)]
    assert {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()} == {i: 0 for i in range(21)} | {i: 100 for i in range(100, 140)}


def test_names_do_not_depend_on_the_partitioning(spark, docs, monkeypatch):
    monkeypatch.setattr(exact_dedup, "RANGE", 16)
    names = [{(r.doc_id, r.level, r.name) for r in exact_dedup.block_identities(docs.repartition(n), block_chars=50).collect()} for n in (1, 7)]
    assert names[0] == names[1] and len({n for _, _, n in names[0]}) > 40


@pytest.mark.parametrize("name", ["op2_fingerprint_runs", "op4_minmax_near_dedup", "op9_exact_dedup"])
def test_queries_equal_their_sql(spark, small, name):
    import duckdb

    from ravenna.llm import queries

    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{small}/documents.parquet')")
    ran = con.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in ran.description]
    got = queries.queries()[name](spark, small).select(*columns).collect()
    assert sorted(tuple(r) for r in got) == sorted(ran.fetchall())


def test_very_long_texts(spark):
    """Texts of over a megabyte: a copy, a near copy, a repeated passage, a leak near the end."""
    rng = random.Random(12)
    long = [f"w{rng.randrange(5000)}" for _ in range(200_000)]
    passage, item = [f"p{i}" for i in range(60)], " ".join(f"leak{i}" for i in range(20))
    texts = {0: " ".join(long), 1: " ".join(long), 2: " ".join(long[:-500]), 3: "start " + " ".join(f"z{rng.randrange(5000)}" for _ in range(150_000)) + " " + " ".join(passage) + " " + item, 4: "x " + " ".join(passage) + " y"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(docs).collect()} == {0: (0, 2), 1: (0, 2), 2: (2, 1), 3: (3, 1), 4: (4, 1)}
    assert {r.doc_id: r.component_id for r in near_dedup.near_dedup(docs, 5).collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4}
    want = brute_removed(texts)
    assert {r.doc_id: r.n_words - r.n_removed for r in substring_dedup.substring_dedup(docs).collect()} == {i: len(w) for i, w in want.items()}
    assert [(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()] == [(3, 7)]
    assert {r.doc_id: r.size for r in sharding.bounded_load_shards(docs, 2).collect()} == {i: len(t) + 1 for i, t in texts.items()}


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (0, 1)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def brute_removed(texts: dict) -> dict:
    words = {i: t.encode().split() for i, t in texts.items()}
    n = substring_dedup.WINDOW
    seen = Counter(tuple(w[k : k + n]) for w in words.values() for k in range(len(w) - n + 1))
    kept = {}
    for i, w in words.items():
        gone = set()
        for k in range(len(w) - n + 1):
            if seen[tuple(w[k : k + n])] > 1:
                gone.update(range(k, k + n))
        kept[i] = [x for k, x in enumerate(w) if k not in gone]
    return kept


@pytest.mark.parametrize("batches", [1, 3])
def test_substring_dedup_removes_exactly_the_repeats(docs, texts, batches):
    want = brute_removed(texts)
    rows = substring_dedup.substring_dedup(docs, batches).collect()
    assert sum(r.n_removed for r in rows) > 500
    for r in rows:
        words = texts[r.doc_id].encode().split()
        assert (r.n_words, r.n_removed) == (len(words), len(words) - len(want[r.doc_id]))
        assert r.kept_sha256 == hashlib.sha256(b" ".join(want[r.doc_id])).hexdigest()
        assert sum(s.end - s.start for s in r.spans) == r.n_removed


def test_substring_dedup_query_against_brute_force(spark, small):
    from ravenna.llm import queries

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    want = brute_removed(texts)
    for r in queries.op2_fingerprint_runs(spark, small).collect():
        assert r.kept_sha256 == hashlib.sha256(b" ".join(want[r.doc_id])).hexdigest()


def test_substring_dedup_odd_rows(spark):
    assert {(r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.substring_dedup(odd_rows(spark)).collect()} == {(1, 4, 0), (None, 4, 0), (None, 0, 0), (2, 0, 0)}
    assert substring_dedup.substring_dedup(odd_rows(spark).limit(0)).count() == 0


def test_index_is_incremental_and_compacts(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "PART", 4)
    monkeypatch.setattr(substring_dedup, "FAN", 2)
    index = substring_dedup.FingerprintIndex(spark)
    rng = random.Random(2)
    seen: Counter = Counter()
    for _ in range(5):
        batch = [[rng.randrange(-(2**63), 2**63) if rng.random() < 0.5 else rng.randrange(40) for _ in range(20)] for _ in range(3)]
        seen.update(x for b in batch for x in b)
        got = {r.fingerprint for r in index.add(spark.createDataFrame([(b,) for b in batch], "chosen array<long>")).collect()}
        assert got == {x for b in batch for x in b if seen[x] > 1}
    assert len(index.runs) <= 2


def test_word_hashes_do_not_depend_on_what_is_remembered(monkeypatch):
    import xxhash

    texts = [b"one two three two", b"four one", b" ".join(b"w%d" % i for i in range(9)), b"one w3"]
    monkeypatch.setattr(substring_dedup, "CACHE_WORDS", 5)
    windows = substring_dedup.Windows(2)
    for t in texts * 2:
        assert windows.words(t.split()).tolist() == [[xxhash.xxh3_64_intdigest(w, seed) for w in t.split()] for seed in (0, 1)]


def edit_distance(a: str, b: str) -> int:
    row = [0] * (len(b) + 1)
    for i, c in enumerate(a, 1):
        last, row = row, [i]
        for j, d in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (c != d)))
    return min(row)


def test_myers_is_the_edit_distance():
    rng = random.Random(4)
    for _ in range(200):
        a = "".join(rng.choices("abc", k=rng.randint(1, 30)))
        b = "".join(rng.choices("abc", k=rng.randint(0, 20))) + a[: rng.randint(0, 30)] + "".join(rng.choices("abc", k=5))
        assert decontaminate.myers(a, b)[0] == edit_distance(a, b)


def edited(text: str, n: int, rng: random.Random) -> str:
    chars = list(text)
    for _ in range(n):
        k = rng.randrange(len(chars))
        rng.choice([lambda: chars.__setitem__(k, "q"), lambda: chars.insert(k, "q"), lambda: chars.pop(k)])()  # noqa: B023
    return "".join(chars)


@pytest.mark.parametrize("block_chars", [100, 10**6])
def test_leaks_within_the_budget_and_only_those(spark, block_chars):
    rng = random.Random(9)
    letters = "abcdefghijklmnoprst"
    items = [(i, " ".join("".join(rng.choices(letters, k=rng.randint(2, 8))) for _ in range(rng.randint(8, 30)))) for i in range(12)] + [(90, None), (91, " .!"), (92, "tiny one")]
    filler = lambda: " ".join("".join(rng.choices(letters, k=5)) for _ in range(20))
    rows = []
    for i, t in items[:12]:
        budget = int(len(decontaminate.plain(t)) * decontaminate.RATE)
        rows += [(i * 10 + k, f"{filler()}. {edited(t, n, rng).upper()}! {filler()}") for k, n in enumerate((0, budget // 2, budget, 4 * budget + 8))]
    rows += [(900, None), (901, ""), (902, "xtiny one"), (903, "a TINY, one b"), (None, items[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    want = set()
    for d, t in rows:
        for i, x in items:
            x = decontaminate.plain(x or "")
            if x and t:
                budget = int(len(x) * decontaminate.RATE)
                distance = edit_distance(x, decontaminate.plain(t)) if budget else 0 if f" {x} " in f" {decontaminate.plain(t)} " else 1
                if distance <= budget:
                    want.add((d, i, distance))
    got = {(r.doc_id, r.item_id, r.distance) for r in decontaminate.find_leaks(docs, benchmark, block_chars=block_chars).collect()}
    assert {(d, i) for d, i, _ in got} == {(d, i) for d, i, _ in want}
    assert len(want) >= 36
    clean = {r.doc_id for r in decontaminate.drop_leaks(docs, benchmark, block_chars=block_chars).collect()}
    assert clean == {d for d, _ in rows} - {d for d, _, _ in want}
    assert decontaminate.find_leaks(docs.limit(0), benchmark).count() == 0
    assert decontaminate.drop_leaks(docs, benchmark.limit(0)).count() == len(rows)


def test_shard_query_against_a_walk_round_the_ring(spark, small):
    """Every row goes to the first shard clockwise with room: rows of all arcs first to their own, what overflows in the order of the arcs."""
    import zlib

    from ravenna.llm import queries

    docs = spark.read.parquet(f"{small}/documents.parquet")
    keys = {r.doc_id: r.h % (1 << 64) for r in docs.selectExpr("doc_id", "xxhash64(cast(doc_id as string)) as h").collect()}
    cells, owners = sharding.ring(8, 64)
    arc = {i: next((k for k, c in enumerate(cells) if c >= h >> 48), 0) for i, h in keys.items()}
    # within an arc by the key's cells; the arc over the ring's start has the low cells first
    order = sorted(keys, key=lambda i: (arc[i], keys[i]))
    room = [len(keys) // 8 + (s < len(keys) % 8) for s in range(8)]
    shard, over = {}, []
    for i in order:
        own = owners[arc[i]]
        if room[own]:
            room[own] -= 1
            shard[i] = own
        else:
            over.append(i)
    for i in over:
        k = arc[i]
        while not room[owners[k]]:
            k = (k + 1) % len(owners)
        room[owners[k]] -= 1
        shard[i] = owners[k]
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    rows = queries.op3_ring_shards(spark, small).collect()
    assert {r.doc_id: r.shard for r in rows} == shard
    assert all((r.size, r.text_crc32, r.law, r.grown_shard) == (len(texts[r.doc_id]) + 1, zlib.crc32(texts[r.doc_id]), "rows", None) for r in rows)
    for s in range(8):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(x == s for x in shard.values())))


def least_distance(item: str, text: str) -> int:
    """The least edit distance between `item` and any stretch of `text`, a character of the item at a time."""
    t = np.array([ord(c) for c in text], np.int32)
    place, row = np.arange(len(t) + 1), np.zeros(len(t) + 1, np.int64)
    for k, c in enumerate(item, 1):
        new = np.minimum(row[1:] + 1, row[:-1] + (t != ord(c)))
        row = np.minimum.accumulate(np.concatenate([[k], new]) - place) + place
    return int(row.min())


def test_leak_query_against_edit_distances(spark, small):
    from ravenna.llm import queries

    texts = {r.doc_id: decontaminate.plain(r.text or "") for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    items = {r.item_id: decontaminate.plain(r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()}
    want = {(d, i): n for d, t in texts.items() for i, x in items.items() if t and (n := least_distance(x, t)) <= int(len(x) * decontaminate.RATE)}
    assert len(want) >= 3
    assert {(r.doc_id, r.item_id): r.distance for r in queries.op5_pigeonhole_leaks(spark, small).collect()} == want


def test_shards_differ_by_one_row_and_slots_have_no_gaps(docs, texts):
    for shards in (1, 3, 8):
        rows = sharding.bounded_load_shards(docs, shards).collect()
        by = defaultdict(list)
        for r in rows:
            by[r.shard].append(r.slot)
        sizes = [len(by[s]) for s in range(shards)]
        assert sum(sizes) == len(texts) and max(sizes) - min(sizes) <= 1
        assert all(sorted(x) == list(range(len(x))) for x in by.values())
        assert {r.doc_id: r.size for r in rows} == {i: len(t.encode()) + 1 for i, t in texts.items()}


def test_few_rows_move_to_a_new_shard(spark):
    docs = spark.range(4000).selectExpr("id as doc_id", "'x' as text")
    place = {n: {r.doc_id: r.shard for r in sharding.bounded_load_shards(docs, n).collect()} for n in (8, 9)}
    moved = sum(place[8][i] != place[9][i] for i in place[8])
    assert moved < 0.5 * len(place[8])  # dealing by remainder would move eight ninths
    loads = Counter(r.shard for r in sharding.bounded_load_shards(docs, 8, slack=0.1).collect())
    assert max(loads.values()) <= 1.1 * 500 + 1


def test_rows_of_one_id_are_ranked_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(sharding, "CELL_ROWS", 4)
    docs = spark.range(300).selectExpr("case when id % 3 = 0 then 7 when id % 3 = 1 then null else id end as doc_id", "'same' as text")
    rows = sharding.bounded_load_shards(docs, 4).collect()
    assert sorted((r.shard, r.slot) for r in rows) == [(s, k) for s in range(4) for k in range(75)]


def test_overflow_goes_clockwise():
    pieces = sharding.plan_overflow([5, 1, 0], [0, 1, 0], [2, 4])
    assert sorted(pieces) == [(0, 0, 2, 0, 0), (0, 2, 5, 1, 1), (1, 0, 1, 1, 0)]


def test_shards_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(sharding, "CELL_ROWS", 1)
    rows = sharding.bounded_load_shards(odd_rows(spark), 2).collect()
    assert sorted((r.shard, r.slot) for r in rows) == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (1, 2)]
    assert sorted(r.size for r in rows) == [1, 1, 8, 8, 8, 8] and {r.text_crc32 for r in rows if r.size == 1} == {0}
    assert sharding.bounded_load_shards(odd_rows(spark).limit(0), 2).count() == 0
