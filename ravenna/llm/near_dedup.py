"""Near-duplicate detection by min-max hashing.

Every document's set of word shingles is hashed by a number of random permutations, and of each both the least and the
greatest value are kept, so half as many hash evaluations give a signature of the same length. Bands of the signature
name buckets; documents that share a bucket are candidates, and links are confirmed on the full shingle sets.

* Documents with the same words in the same order form one class; from then on classes stand for them. Whatever else is linked is
  confirmed on full sets, equal sets included.
* Only classes in buckets with others go on. In a few rounds every class is compared with one random class of a bucket, the one that
  it shares most buckets with; confirmed links merge components, so a large group of copies is joined along few links.
* Then all pairs of a bucket that still lie in different components are compared, in pairs of blocks of bounded size that are dealt out
  each by itself, by whole signatures, and those that may reach the threshold on their full sets; only links that join components
  come out. Nothing is left out: a pair inside one component needs no check, as only components are asked for.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravenna.llm._arrow import map_slices, texts_of
from ravenna.llm._rows import HOT_ROWS, numbered, small, split_join
from ravenna.llm.components import FILES, components
from ravenna.session import materialize, release, ship_package

#: Values of a band and bands. At a similarity of 0.8 a pair shares no band once in eight million.
ROWS, BANDS = 5, 40
HASHES = ROWS * BANDS // 2
#: How far a signature's estimate may lie below the threshold before its pair is put aside: over five standard deviations.
MARGIN = 0.15
ROUNDS = 3
#: Members of a block of signatures on average, and bytes of a block of texts; a longer text is a block by itself or with few others.
BLOCK, TEXT_BLOCK = 1024, 2 << 20
#: Values that a byte of a signature can have; two different sets agree in one of so many by chance.
CHANCE = 1 / 256
CACHE_WORDS = 150_000
UPPER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
M64 = (1 << 64) - 1


def words_of(text: str) -> list[bytes]:
    """Words between ASCII white space, with A-Z in lower case."""
    return text.encode().translate(UPPER).split()


def shingles(words: list[bytes], size: int) -> set[tuple[bytes, ...]]:
    """The distinct runs of `size` words; of fewer words the whole sequence; none of none."""
    if len(words) < size:
        return {tuple(words)} if words else set()
    return set(zip(*(words[k:] for k in range(size)), strict=False))


def linked(a: set, b: set, percent: int) -> bool:
    both = len(a & b)
    return bool(a and b) and 100 * both >= percent * (len(a) + len(b) - both)


class Signer:
    """Signatures of texts; words' hashes are remembered within a bound."""

    def __init__(self, size: int, seed: int = 23):
        rng = np.random.default_rng(seed)
        self.size, self.known = size, {}
        self.factor = rng.integers(0, 1 << 63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1)
        self.shift = rng.integers(0, 1 << 63, HASHES, np.uint64)
        self.mix = rng.integers(0, 1 << 63, size, np.uint64) * np.uint64(2) + np.uint64(1)

    def hashes(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        new = [w for w in set(words) if w not in known]
        if new:
            if len(known) + len(new) > CACHE_WORDS:
                known.clear()
                new = set(words)
            known.update((w, xxhash.xxh3_64_intdigest(w)) for w in new)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))

    def shingle_hashes(self, words: list[bytes]) -> np.ndarray:
        """Distinct 64-bit hashes of the shingles, sorted."""
        n = len(words)
        if n < self.size:
            return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), n)] if n else [], np.uint64)
        h, out = self.hashes(words), np.zeros(n - self.size + 1, np.uint64)
        for k in range(self.size):
            out += h[k : n - self.size + 1 + k] * self.mix[k]
            out ^= out >> np.uint64(29)
            out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
        return np.unique(out)

    def signature(self, found: np.ndarray) -> bytes:
        """A byte of the least and of the greatest value under each permutation: least values first."""
        least, most = np.full(HASHES, M64, np.uint64), np.zeros(HASHES, np.uint64)
        for k in range(0, len(found), 2048):
            v = np.multiply.outer(self.factor, found[k : k + 2048])
            v += self.shift[:, None]
            np.minimum(least, v.min(1), out=least)
            np.maximum(most, v.max(1), out=most)
        both = np.concatenate([least, most])
        return ((both * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)).astype(np.uint8).tobytes()


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, print, n_shingles, key, sig): key is a cryptographic digest of the words, null without any; print hashes the text."""

    def make():
        signer = Signer(size)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, keys, sigs = [], [], []
            for t in texts_of(batch):
                words = words_of(t)
                found = signer.shingle_hashes(words)
                n.append(len(found))
                keys.append(hashlib.blake2b(b" ".join(words), digest_size=16).digest() if words else None)
                sigs.append(signer.signature(found) if len(found) else None)
            arrays = [batch.column("doc_id"), batch.column("print"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, ["doc_id", "print", "n_shingles", "key", "sig"])

        return step

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("print"))
    return map_slices(rows, make, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, print long, n_shingles long, key binary, sig binary")


def similarity(agreeing: np.ndarray) -> np.ndarray:
    """The unbiased estimate of the similarity, given the share of a signature's bytes that agree."""
    return (agreeing - CHANCE) / (1 - CHANCE)


def _confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose texts' full shingle sets are similar enough, as edges (u, v)."""
    ship_package(pairs.sparkSession)
    pairs = materialize(pairs.select("a", "b").distinct(), "near-pairs", FILES)
    wanted = materialize(pairs.select("b").distinct(), "near-wanted", FILES)
    left = texts.join(small(pairs), texts["cid"] == pairs["a"]).select("a", "b", F.col("text").alias("text_a"))
    right = texts.join(small(wanted), texts["cid"] == wanted["b"], "left_semi").select(F.col("cid").alias("b"), F.col("text").alias("text_b"))

    def check(batches):
        last, seen = None, set()
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part, keep = batch.slice(k, 64), []
                for i, (b, x, y) in enumerate(zip(*(part.column(c).to_pylist() for c in ("b", "text_a", "text_b")), strict=True)):
                    if b != last:
                        last, seen = b, shingles(words_of(y), size)
                    if linked(shingles(words_of(x), size), seen, percent):
                        keep.append(i)
                if keep:
                    some = part.take(pa.array(keep))
                    yield pa.RecordBatch.from_arrays([some.column("a"), some.column("b")], ["u", "v"])

    edges = materialize(left.join(right, "b").select("a", "b", "text_a", "text_b").mapInArrow(check, "u long, v long"), "near-edges", FILES)
    release(pairs, wanted)
    return edges


def _merge(comp: DataFrame, edges: DataFrame) -> DataFrame:
    """comp (cid, comp) after joining components along `edges` (u, v) of cids."""
    named = edges.join(comp.select(F.col("cid").alias("u"), F.col("comp").alias("cu")), "u").join(comp.select(F.col("cid").alias("v"), F.col("comp").alias("cv")), "v")
    roots = components(named.select(F.col("cu").alias("u"), F.col("cv").alias("v")), "near-components")
    roots = materialize(roots.withColumnRenamed("node", "comp"), "near-roots", FILES)
    out = materialize(comp.join(small(roots), "comp", "left").select("cid", F.coalesce("root", "comp").alias("comp")), "near-comp", FILES)
    release(comp, edges, roots)
    return out


def _round(multi: DataFrame, comp: DataFrame, seed: int, least: float) -> DataFrame:
    """For every class a pair (a, b) with a random class of one of its buckets, of another component and a similar size."""
    pick = F.min(F.struct(F.xxhash64("cid", F.lit(seed)).alias("h"), F.col("cid").alias("b"), F.col("comp").alias("comp_b"), F.col("n").alias("n_b"))).alias("p")
    rows = multi.join(comp, "cid")
    chosen = rows.groupBy("bucket", "m").agg(pick).select("bucket", "m", "p.b", "p.comp_b", "p.n_b")
    fit = (F.least("n", "n_b") >= least * F.greatest("n", "n_b")) & (F.col("comp") != F.col("comp_b"))
    # buckets of very many classes, of which there are few, are joined by broadcast
    hot = F.col("m") > HOT_ROWS
    both = rows.where(~hot).join(chosen.where(~hot).drop("m"), "bucket")
    if (multi.agg(F.max("m")).first()[0] or 0) > HOT_ROWS:
        both = both.unionByName(rows.where(hot).join(F.broadcast(chosen.where(hot).drop("m")), "bucket"))
    shared = both.where(fit).groupBy("cid", "b").agg(F.count("*").alias("times"))
    return shared.groupBy("cid").agg(F.max(F.struct("times", F.xxhash64("b", F.lit(seed)), "b")).alias("best")).select(F.col("cid").alias("a"), "best.b")


def _survivors(a: dict, b: dict, band: int, least: float, need: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each row of block a the places in block b, and their estimates, of other components that sizes and signatures allow.

    A pair counts only in the first band that it shares, and once if both blocks hold it both ways.
    """
    found = []
    for i in range(len(a["cid"])):
        n = a["n"][i]
        fit = (b["comp"] != a["comp"][i]) & (np.minimum(b["n"], n) >= least * np.maximum(b["n"], n)) & ~(b["out"] & (b["cid"] <= a["cid"][i]))
        fit = np.flatnonzero(fit)
        same = b["sig"][fit] == a["sig"][i]
        estimate = similarity(same.mean(1))
        keep = (estimate >= need) & (same.reshape(-1, BANDS, ROWS).all(2).argmax(1) == band)
        found.append((fit[keep], estimate[keep]))
    return found


def _block(side: pa.StructArray, k: int) -> dict:
    """The columns of the k-th block."""
    get = lambda c: side.field(c)[k].values
    block = {c: get(c).to_numpy(zero_copy_only=False) for c in ("cid", "comp", "n", "out")}
    return block | {"sig": np.frombuffer(b"".join(get("sig").to_pylist()), np.uint8).reshape(-1, 2 * HASHES)}


def _paired(rows: DataFrame, columns: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(bucket, band, block_a, block_b, a, b), and the table that it reads: every block with a row outside its bucket's main component beside every block of the bucket.

    `rows` has, beside `columns`, bucket, band, out, block and blocks, the number of its bucket's blocks. A bucket of one block is compared
    with itself, and its b is null. Blocks of larger buckets meet by the names of both, so the pairs of one bucket are many tasks'.
    """
    packs = rows.groupBy("bucket", "band", "block", "blocks").agg(F.max("out").alias("any_out"), *(F.collect_list(c).alias(c) for c in columns))
    packs, content = materialize(packs, "near-packs", None), F.struct(*columns)
    own = packs.where("blocks = 1 and any_out").select("bucket", "band", F.col("block").alias("block_a"), F.col("block").alias("block_b"), content.alias("a"))
    own = own.withColumn("b", F.lit(None).cast(own.schema["a"].dataType))
    split = packs.where("blocks > 1")
    if split.isEmpty():
        return own, packs
    keys = split.where("any_out").select("bucket", "band", F.col("block").alias("block_a")).join(split.select("bucket", F.col("block").alias("block_b")), "bucket")
    side = lambda s: split.select("bucket", F.col("block").alias(f"block_{s}"), content.alias(s))
    return own.unionByName(keys.join(side("a"), ["bucket", "block_a"]).join(side("b"), ["bucket", "block_b"]).select(*own.columns)), packs


def _across(multi: DataFrame, comp: DataFrame, classes: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Edges (u, v) that join all components of which a bucket holds a similar pair.

    The signatures of a bucket's blocks are compared first. Rows that are left with a possible partner get their texts, are packed
    into blocks of bounded bytes, and are compared on full sets; of a pair of blocks only links between components come back, so
    what leaves a task is bounded by what it read.
    """
    ship_package(multi.sparkSession)
    rows = multi.drop("m").join(comp, "cid")
    by = rows.groupBy("bucket", "comp").agg(F.count("*").alias("m"))
    most = by.groupBy("bucket").agg(F.max_by("comp", "m").alias("main"), F.sum("m").alias("m"), F.count("*").alias("comps")).where("comps > 1").select("bucket", "main", F.ceil(F.col("m") / BLOCK).alias("blocks"))
    most = materialize(most, "near-mixed", FILES)
    rows = rows.join(most, "bucket").select("bucket", "band", "cid", "comp", "n", (F.col("comp") != F.col("main")).alias("out"), F.pmod(F.xxhash64("cid"), "blocks").alias("block"), "blocks")
    rows = materialize(rows.join(classes.select("cid", "sig"), "cid"), "near-mixed-rows")
    columns, least = ("cid", "comp", "n", "out", "sig"), percent / 100
    need = least - MARGIN

    def possible(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                a = _block(batch.column("a"), k)
                b = _block(batch.column("b"), k) if batch.column("b")[k].is_valid else a
                found = _survivors(a, b, batch.column("band")[k].as_py(), least, need)
                cids = np.unique(np.concatenate([a["cid"][[i for i, (at, _) in enumerate(found) if len(at)]], *(b["cid"][at] for at, _ in found)]))
                if len(cids):
                    yield pa.RecordBatch.from_arrays([pa.array([batch.column("bucket")[k].as_py()], pa.int64()), pa.array([cids], pa.list_(pa.int64()))], ["bucket", "cids"])

    pairs, packs = _paired(rows, columns)
    left = materialize(pairs.mapInArrow(possible, "bucket long, cids array<long>"), "near-possible", FILES)
    release(packs)
    wanted = left.select("bucket", F.explode("cids").alias("cid")).distinct()
    sized = texts.select("cid", F.octet_length("text").alias("bytes"))
    room = wanted.join(sized, "cid").groupBy("bucket").agg(F.ceil(F.sum("bytes") / TEXT_BLOCK).alias("blocks"))
    room = materialize(room.select("bucket", F.greatest("blocks", F.lit(1)).alias("blocks")), "near-room", FILES)
    wanted = materialize(wanted.join(room, "bucket"), "near-wanted-rows", FILES)
    signed = rows
    rows = rows.drop("block", "blocks").join(wanted, ["bucket", "cid"]).withColumn("block", F.pmod(F.xxhash64("cid", F.lit(1)), "blocks")).join(texts, "cid")

    def compare(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                alone = not batch.column("b")[k].is_valid
                a = _block(batch.column("a"), k)
                b = a if alone else _block(batch.column("b"), k)
                found = _survivors(a, b, batch.column("band")[k].as_py(), least, need)
                text = {"a": batch.column("a").field("text")[k].values}
                text["b"] = text["a"] if alone else batch.column("b").field("text")[k].values
                sets: dict[tuple[str, int], set] = {}
                names: dict[tuple, int] = {}
                root: dict[int, int] = {}

                def of(c: int) -> int:
                    while (up := root.get(c, c)) != c:
                        c = up
                    return c

                def shingled(s: str, i: int) -> set:
                    s = "a" if alone else s
                    if (s, i) not in sets:
                        sets[s, i] = {names.setdefault(x, len(names)) for x in shingles(words_of(text[s][i].as_py()), size)}
                    return sets[s, i]

                us, vs = [], []
                for i, (at, estimate) in enumerate(found):
                    for j in at[np.argsort(-estimate, kind="stable")]:
                        x, y = of(int(a["comp"][i])), of(int(b["comp"][j]))
                        if x != y and linked(shingled("a", i), shingled("b", int(j)), percent):
                            root[max(x, y)] = min(x, y)
                            us.append(int(a["cid"][i]))
                            vs.append(int(b["cid"][j]))
                if us:
                    yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    pairs, packs = _paired(rows, (*columns, "text"))
    edges = materialize(pairs.mapInArrow(compare, "u long, v long"), "near-edges", FILES)
    release(packs, signed, most, left, room, wanted)
    return edges


def near_dedup(docs: DataFrame, shingle_words: int = 5, percent: int = 80, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of `docs` (doc_id, text).

    Two rows are linked when 100 * |both| >= percent * |either| for their sets of distinct `shingle_words`-word shingles
    (of fewer words: the whole sequence as one). component_id is the smallest doc_id that links reach, the row's own included;
    kept tells whether it is the row's own. Null and empty texts have an empty set and no links. Rows that repeat an id
    are rows of their own; both are kept if theirs is the smallest id. Rows without id link nothing: their component_id is null and
    they are kept. An empty table gives an empty result; other columns are ignored.
    """
    ship_package(docs.sparkSession)
    rows = materialize(signatures(docs.select("doc_id", "text"), shingle_words), "near-rows", None)
    first = F.min(F.struct("doc_id", "print")).alias("first")
    grouped = rows.where("key is not null and doc_id is not null").groupBy("key").agg(first, F.first("n_shingles").alias("n"), F.first("sig").alias("sig"), F.count("*").alias("members"))
    classes = materialize(grouped.select(F.monotonically_increasing_id().alias("cid"), "key", F.col("first.doc_id").alias("rep"), F.col("first.print").alias("rep_print"), "n", "sig", "members"), "near-classes")
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring("sig", i * ROWS + 1, ROWS)))
    buckets = classes.select(F.posexplode(bands).alias("band", "bucket"), "cid", "n")
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1")
    multi = materialize(buckets.join(shared, "bucket"), "near-buckets", None)
    comp = materialize(multi.select("cid").distinct().withColumn("comp", F.col("cid")), "near-comp", FILES)

    chosen = materialize(classes.join(comp, "cid", "left_semi").select("cid", F.col("rep").alias("i"), F.col("rep_print").alias("p")), "near-chosen", FILES)
    source = docs.select(F.col("doc_id").alias("i"), F.xxhash64("text").alias("p"), "text")
    texts = materialize(source.join(small(chosen), ["i", "p"]).select("cid", "text"), "near-texts", None)
    if texts.count() > chosen.count():  # rows that repeat an id and a text
        texts = materialize(texts.dropDuplicates(["cid"]), "near-texts-once", None)
    for seed in range(rounds):
        comp = _merge(comp, _confirmed(_round(multi, comp, seed, percent / 100), texts, shingle_words, percent))
    comp = _merge(comp, _across(multi, comp, classes, texts, shingle_words, percent))

    named = classes.select("cid", "key", "rep", "members").join(comp, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    named = materialize(named, "near-named", FILES)
    smallest = materialize(named.groupBy("comp").agg(F.min("rep").alias("component_id"), F.count("*").alias("classes")), "near-smallest", FILES)
    members = materialize(split_join(named, smallest, ["comp"], "classes").select("key", "component_id", "members"), "near-members", FILES)
    release(multi, comp, classes, chosen, texts, named, smallest)
    keyed = rows.where("key is not null and doc_id is not null").select("doc_id", "n_shingles", "key")
    ids = split_join(keyed, members, ["key"], "members").select("doc_id", "n_shingles", "component_id")
    rest = rows.where("key is null or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return ids.unionByName(rest).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_copies(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """`docs` with exactly one row of each group of near-duplicates, and all rows with an empty set of shingles.

    Every row is judged by itself, under its id and its number, so rows that repeat an id and rows without id link like
    others. The row with the smallest doc_id stays; null ids come last.
    """
    rows, row = numbered(docs, "near-input")
    own = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(row).alias("row"))
    judged = near_dedup(rows.select(own.alias("doc_id"), "text"), shingle_words, percent)
    gone = materialize(judged.where(~F.col("kept")).select(F.col("doc_id.row").alias("__gone")), "near-gone", FILES)
    return rows.join(small(gone), rows[row] == gone["__gone"], "left_anti").drop(row)
