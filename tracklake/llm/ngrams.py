"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix.

Links are exact for all pairs of texts. The product is never formed over all pairs: column
blocks of the matrix tell which n-grams only one document has, documents whose shared n-grams
cannot reach the bound that their size sets drop out, and only the rest meet in blocks. Column
blocks are as many as the texts' bytes ask for, and an n-gram costs one an entry a batch, however
many of the batch's documents have it.
"""

from __future__ import annotations

import hashlib
import struct as packing

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, materialize, partitions, release, released, struct, text_batches, unused
from .graph import components

WIDTH, NUM, DEN = 5, 3, 4  # words of a shingle; least similarity 3/4
BATCH_CHARS, MOST_CHARS, BATCH_DOCS = 4_000_000, 128_000_000, 60_000  # of a batch of texts, least and most
BLOCK_CHARS = 16_000_000  # text whose entries make a column block
FEW = 500_000  # rows of two numbers that are broadcast
BLOCK = 1024  # sets of a row block
SETS = T.StructType([*struct("sid long, n long").fields, T.StructField("hs", T.ArrayType(T.LongType()))])
INCIDENCE = struct("r int, kind int, batch long, blob binary")
BACK = struct("batch long, kind int, blob binary")


def _mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the shingles of each text.

    Words are split at space and U+0009 to U+000D with A-Z lowered; fewer than five words give
    one shingle, none (or null) the empty set.
    """
    words, sizes = [], []
    for text in texts:
        w = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change
        sizes.append(len(w))
        words += w
    if not words:
        return [np.empty(0, np.uint64) for _ in texts]
    flat = np.empty(len(words), object)
    flat[:] = words
    wh = pd.util.hash_array(flat, categorize=False)
    mult = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        if len(words) >= WIDTH:
            full = np.zeros(len(words) - WIDTH + 1, np.uint64)
            for k in range(WIDTH):
                full = full * mult + wh[k : len(words) - WIDTH + 1 + k]
            full = _mix(full)
        out, at = [], 0
        for n in sizes:
            if n >= WIDTH:
                out.append(np.unique(full[at : at + n - WIDTH + 1]))
            elif n:
                h = np.full(1, n, np.uint64)
                for x in wh[at : at + n]:
                    h = h * mult + x
                out.append(_mix(h * mult + mult))
            else:
                out.append(np.empty(0, np.uint64))
            at += n
    return out


def set_id(hs: np.ndarray) -> int:
    """Signed 64-bit name of a set."""
    return packing.unpack("<q", hashlib.blake2b(hs.astype("<u8").tobytes(), digest_size=8).digest())[0]


def _pack(h: np.ndarray, idx: np.ndarray) -> bytes:
    """Sorted hashes as 32-bit steps (64-bit where one is wider) with 16-bit row numbers."""
    steps = np.diff(h, prepend=h[:1])
    wide = bool(len(h)) and int(steps.max()) >= 1 << 32
    return packing.pack("<QQB", len(h), int(h[0]) if len(h) else 0, wide) + steps.astype("<u8" if wide else "<u4").tobytes() + idx.astype("<u2").tobytes()


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, first, wide = packing.unpack_from("<QQB", blob)
    size = 8 if wide else 4
    steps = np.frombuffer(blob, f"<u{size}", n, 17).astype(np.uint64)
    return np.cumsum(steps, dtype=np.uint64) + np.uint64(first), np.frombuffer(blob, "<u2", n, 17 + size * n)


def _incidence(sets: list[np.ndarray], ids: list[int], batch: int, blocks: int) -> pd.DataFrame:
    """A batch's part of the matrix, cut into column blocks, and its rows' sizes and names.

    Equal sets of a batch are one row; of hashes 48 bits are kept. Kind 0 has entries of n-grams
    that one row has, kind 2 (hash, rows that have it) of the others: their entries stay with the
    rows' sizes and names (kind 1), which go back to the batch as they are.
    """
    first = {s: i for i, s in reversed(list(enumerate(ids)))}
    rows = [(s, _distinct(sets[i] >> np.uint64(16))) for s, i in sorted(first.items()) if len(sets[i])]
    if not rows:
        return pd.DataFrame(columns=INCIDENCE.names)
    sizes = np.array([len(x) for _, x in rows])
    h = np.concatenate([x for _, x in rows])
    idx = np.repeat(np.arange(len(rows), dtype=np.uint16), sizes)
    order = np.argsort(h)
    h, idx = h[order], idx[order]
    start = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    count = np.diff(np.append(start, len(h)))
    many = np.repeat(count > 1, count)
    own = packing.pack("<Q", len(sizes)) + sizes.astype("<i8").tobytes() + np.array([s for s, _ in rows], "<i8").tobytes() + _pack(h[many], idx[many])
    out = [(batch % blocks, 1, batch, own)]
    out += _cut(0, batch, blocks, h[~many], idx[~many].astype("<u2"))
    out += _cut(2, batch, blocks, h[start][count > 1], count[count > 1].astype("<u2"))
    return pd.DataFrame(out, columns=INCIDENCE.names)


def _distinct(h: np.ndarray) -> np.ndarray:
    """A sorted array without repeats."""
    return h if len(h) < 2 else h[np.append(True, h[1:] != h[:-1])]


def _cut(kind: int, batch: int, blocks: int, h: np.ndarray, values: np.ndarray) -> list[tuple[int, int, int, bytes]]:
    """Packed pieces by column block: equal ranges of the hash."""
    r = ((h >> np.uint64(16)) * np.uint64(blocks)) >> np.uint64(32)
    at = np.append(np.flatnonzero(np.append(True, r[1:] != r[:-1])), len(r)) if len(r) else np.zeros(1, int)
    return [(int(r[a]), kind, batch, _pack(h[a:b], values[a:b])) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def _from_texts(blocks: int, batch_chars: int):
    def run(frames):
        part, batch = TaskContext.get().partitionId(), 0
        sets, ids, chars = [], [], 0
        for frame in frames:
            texts = frame["text"].tolist()
            for i in range(0, len(texts), 500):
                more = shingle_sets(texts[i : i + 500])
                sets += more
                ids += map(set_id, more)
                chars += sum(len(x) for x in texts[i : i + 500] if x)
                if chars >= batch_chars or len(sets) >= BATCH_DOCS:
                    yield _incidence(sets, ids, (part << 24) + batch, blocks)
                    sets, ids, chars, batch = [], [], 0, batch + 1
        if sets:
            yield _incidence(sets, ids, (part << 24) + batch, blocks)
        sets.clear()
        release()

    return run


def _from_sets(blocks: int, batch_chars: int):
    def run(frames):
        part, batch = TaskContext.get().partitionId(), 0
        sets, ids, size = [], [], 0
        for frame in frames:
            for sid, hs in zip(frame["sid"].tolist(), frame["hs"], strict=True):
                sets.append(np.asarray(hs, np.uint64) << np.uint64(16))
                ids.append(sid)
                size += len(hs)
                if size >= batch_chars // 6 or len(sets) >= BATCH_DOCS:
                    yield _incidence(sets, ids, (part << 24) + batch, blocks)
                    sets, ids, size, batch = [], [], 0, batch + 1
        if sets:
            yield _incidence(sets, ids, (part << 24) + batch, blocks)
        sets.clear()
        release()

    return run


def _shared(frame: pd.DataFrame) -> pd.DataFrame:
    """Of a column block: the entries whose n-gram another row has too, back to their batches with its count."""
    out = [(b, 1, blob) for b, k, blob in zip(frame["batch"], frame["kind"], frame["blob"], strict=True) if k == 1]
    mine = frame[frame["kind"] != 1]
    parts = [_unpack(x) for x in mine["blob"]]
    if parts:
        names, inverse = np.unique(np.concatenate([h for h, _ in parts]), return_inverse=True)
        rows = np.concatenate([np.ones(len(h), np.int64) if k == 0 else v.astype(np.int64) for k, (h, v) in zip(mine["kind"], parts, strict=True)])
        df, at = np.bincount(inverse, rows, len(names)).astype(np.int64)[inverse], 0
        for batch, kind, (h, v) in zip(mine["batch"], mine["kind"], parts, strict=True):
            own = df[at : at + len(h)]
            at += len(h)
            keep = own > 1
            if keep.any():
                out.append((batch, kind, _pack(h[keep], v[keep]) + np.minimum(own[keep], (1 << 32) - 1).astype("<u4").tobytes()))
    parts = mine = None
    release()
    return pd.DataFrame(out, columns=BACK.names)


def _rows(frame: pd.DataFrame):
    """(name, size, shared hashes sorted, their counts) of a batch's rows that can reach the bound of their size."""
    meta = frame["blob"][frame["kind"] == 1].iloc[0]
    (n,) = packing.unpack_from("<Q", meta)
    sizes, ids = np.frombuffer(meta, "<i8", 2 * n, 8).reshape(2, -1)
    back: dict[int, list] = {0: [], 2: []}
    for kind, blob in zip(frame["kind"], frame["blob"], strict=True):
        if kind != 1:
            h, v = _unpack(blob)
            back[kind].append((h, v, np.frombuffer(blob[len(blob) - 4 * len(h) :], "<u4")))
    parts = back[0]
    if back[2]:
        names, _, df = (np.concatenate(x) for x in zip(*back[2], strict=True))
        order = np.argsort(names)
        h, idx = _unpack(meta[8 + 16 * n :])
        parts.append((h, idx, df[order][np.searchsorted(names[order], h)]))
    if not parts:
        return
    h, idx, df = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((h, idx))
    h, idx, df = h[order], idx[order], df[order]
    cut = np.searchsorted(idx, np.arange(len(sizes) + 1))
    for i in np.flatnonzero(DEN * np.diff(cut) >= NUM * sizes):
        a, b = cut[i], cut[i + 1]
        yield int(ids[i]), int(sizes[i]), h[a:b], df[a:b]


def _survivors(frame: pd.DataFrame) -> pd.DataFrame:
    rows = [(sid, n, h.astype(np.int64)) for sid, n, h, _ in _rows(frame)]
    return pd.DataFrame(rows, columns=SETS.names)


def _prefixes(frame: pd.DataFrame) -> pd.DataFrame:
    """The rarest n-grams of each row, as many as two similar sets cannot both do without.

    In one order of all n-grams, sets with similarity t share one of the first n - ceil(t n) + 1
    of each; those of one row alone come first and are none of them.
    """
    rows = []
    for sid, n, h, df in _rows(frame):
        room = n - -(-NUM * n // DEN) + 1 - (n - len(h))
        if room > 0:
            rows.append((sid, n, h[np.lexsort((h, df))[:room]].astype(np.int64)))
    return pd.DataFrame(rows, columns=SETS.names)


def _product(frame: pd.DataFrame) -> pd.DataFrame:
    """Overlaps of all rows of a block by sparse rows times columns; a row (u, v) hangs a set on its group's first."""
    sets = [np.asarray(x, np.int64) for x in frame["hs"]]
    sid, n = frame["sid"].to_numpy(), frame["n"].to_numpy()
    m = len(sets)
    size = np.array([len(x) for x in sets])
    _, col, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(m), size)
    keep = count[col] > 1
    row, col = row[keep], col[keep]
    by_col = np.argsort(col, kind="stable")
    posting = row[by_col]
    start = np.searchsorted(col[by_col], np.arange(len(count)))
    stop = start + np.where(count > 1, count, 0)
    cut = np.searchsorted(row, np.arange(m + 1))
    label = np.arange(m)
    for x in range(m - 1):
        cols = col[cut[x] : cut[x + 1]]
        if not len(cols):
            continue
        a, width = start[cols], stop[cols] - start[cols]
        at = np.repeat(a - np.concatenate([[0], np.cumsum(width)[:-1]]), width) + np.arange(width.sum())
        overlap = np.bincount(posting[at], minlength=m)
        linked = (NUM + DEN) * overlap >= NUM * (n + n[x])
        linked[: x + 1] = False
        for g in np.unique(label[linked]):
            if g != label[x]:
                low, high = sorted((g, label[x]))
                label[label == high] = low
    root = np.full(m, np.iinfo(np.int64).max)
    np.minimum.at(root, label, sid)
    root = root[label]
    other = root != sid
    return pd.DataFrame({"u": sid[other], "v": root[other]})


def _counted(blobs: DataFrame, after, schema) -> DataFrame:
    return blobs.groupBy("r").applyInPandas(_shared, BACK).groupBy("batch").applyInPandas(after, schema)


def _written(df: DataFrame, label: str) -> DataFrame:
    """A scratch table; the shuffles that made it are gone when it is written, so the disk holds those of one step."""
    with released(df.sparkSession):
        return materialize(df, label)


def linked_sets(df: DataFrame, text: str = "text") -> DataFrame:
    """(sid, root) of the distinct shingle sets that may link to another; root names the group.

    1. Texts become an incidence matrix in column blocks; a block counts each n-gram's documents
       exactly. Only documents with three quarters of their n-grams elsewhere can have a partner.
    2. The same once more among the distinct sets left gives each its rarest n-grams; sets that
       share one of them, and whose sizes can match, form coarse groups.
    3. A group of up to 1,024 sets is multiplied in one block. A larger one is dealt to blocks of
       that size, each with some of the group's sets for pivots beside its own. What then hangs
       together with most of the group needs no further comparison among itself; every other
       set meets the whole group in pairs of blocks. No task holds an unbounded group.

    Null texts and texts without words have no set. Repeated texts are one set.
    """
    spark = df.sparkSession
    text_batches(spark)
    texts = df.select(F.col(text).alias("text"))
    chars = texts.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    blocks = max(32, 4 * partitions(spark), -(-chars // BLOCK_CHARS))
    batch_chars = min(max(BATCH_CHARS, 96 * blocks), MOST_CHARS)  # so many that a piece of a batch stays worth a row
    sets = _counted(texts.mapInPandas(_from_texts(blocks, batch_chars), INCIDENCE), _survivors, SETS)
    sets = _written(sets.groupBy("sid").agg(F.first("n").alias("n"), F.first("hs").alias("hs")), "sets")
    prefix = _written(_counted(sets.mapInPandas(_from_sets(blocks, batch_chars), INCIDENCE), _prefixes, SETS), "prefixes")
    # sizes of two similar sets lie in one band or in neighbouring ones
    band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(DEN / NUM))).cast("long")
    grams = prefix.select("sid", band.alias("band"), F.explode("hs").alias("h"))
    first = _written(grams.groupBy("h", "band").agg(F.min("sid").alias("v"), F.count(F.lit(1)).alias("n")), "grams")
    inside = grams.join(first.filter("n > 1").drop("n"), ["h", "band"]).select(F.col("sid").alias("u"), "v")
    next_ = first.select("h", (F.col("band") - 1).alias("band"), F.col("v").alias("u"))
    across = first.select("h", "band", "v").join(next_, ["h", "band"]).select("u", "v")
    coarse = _written(components(inside.unionByName(across)).select(F.col("node").alias("sid"), "root"), "coarse")
    discard(prefix, first)
    groups = _written(coarse.groupBy("root").agg(F.count(F.lit(1)).alias("size")), "sizes")
    placed = _written(coarse.join(groups, "root").withColumn("parts", F.ceil(F.col("size") / BLOCK).cast("int")), "placed")
    discard(coarse, groups)
    many = max(1, -(-placed.count() // BLOCK))
    nothing = F.lit(-1).cast("long")
    dealt = lambda parts: F.pmod(F.xxhash64("sid"), F.col(parts)).cast("long")
    key = F.when(F.col("parts") == 1, F.struct(F.pmod(F.xxhash64("root"), F.lit(many)).alias("a"), nothing.alias("i"), nothing.alias("j")))
    key = key.otherwise(F.struct(F.col("root").alias("a"), dealt("parts").alias("i"), nothing.alias("j")))
    pivots = placed.filter("parts > 1").groupBy("root", "parts", F.pmod(F.xxhash64("sid", F.lit(1)), F.lit(PIVOTS)).alias("k")).agg(F.min("sid").alias("sid"))
    pivots = pivots.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1))).select("sid", F.struct(F.col("root").alias("a"), "i", nothing.alias("j")).alias("key"))
    links = _written(_multiplied(placed.select("sid", key.alias("key")).unionByName(pivots).distinct(), sets), "links")
    large = placed.filter("parts > 1").drop("size")
    if not large.isEmpty():
        links = links.unionByName(_multiplied(_others(large, links), sets))
    out = components(links).select(F.col("node").alias("sid"), "root")
    discard(sets, placed)
    return out


PIVOTS = 32  # sets of a large group that each of its blocks has beside its own


def _multiplied(keyed: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (u, v) within blocks: ``keyed`` (sid, key) deals sets to them."""
    return keyed.join(sets, "sid").groupBy("key").applyInPandas(_product, struct("u long, v long"))


def _others(large: DataFrame, links: DataFrame) -> DataFrame:
    """(sid, key): pairs of blocks in which each set that does not hang together with most of its group meets the whole group."""
    labels = components(links).withColumnsRenamed({"node": "of", "root": "label"})
    labelled = _written(large.join(labels, large["sid"] == labels["of"], "left").select("sid", "root", F.coalesce("label", "sid").alias("label")), "labelled")
    sizes = labelled.groupBy("root", "label").agg(F.count(F.lit(1)).alias("m"))
    main = sizes.groupBy("root").agg(F.max_by("label", F.struct("m", "label")).alias("main"), F.max("m").alias("most"), F.sum("m").alias("all"))
    blocks = lambda n: F.ceil(n / BLOCK).cast("long")
    main = _written(main.select("root", "main", blocks(F.col("most")).alias("mine"), blocks(F.col("all") - F.col("most")).alias("rest")).filter("rest > 0"), "main")
    met = labelled.join(main, "root").withColumn("own", F.col("label") == F.col("main"))
    place = F.pmod(F.xxhash64("sid"), F.when(F.col("own"), F.col("mine")).otherwise(F.col("rest"))).cast("long")
    met = met.withColumn("i", place)
    up_to = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    # a block of others is named by its number, one of the main part by -2 less its number
    with_main = F.transform(up_to(F.col("mine")), lambda j: F.struct(F.col("root").alias("a"), F.col("i").alias("i"), (-2 - j).alias("j")))
    with_rest = F.transform(up_to(F.col("rest")), lambda j: F.struct(F.col("root").alias("a"), F.least("i", j).alias("i"), F.greatest("i", j).alias("j")))
    mains = F.transform(up_to(F.col("rest")), lambda j: F.struct(F.col("root").alias("a"), j.alias("i"), (-2 - F.col("i")).alias("j")))
    return met.select("sid", F.explode(F.when(F.col("own"), mains).otherwise(F.concat(with_main, with_rest))).alias("key"))


def _named(batches):
    for batch in batches:  # Arrow keeps ids exact beside nulls
        sets, texts = [], batch.column("text")
        for i in range(0, len(texts), 500):
            sets += [(len(x), set_id(x) if len(x) else None) for x in shingle_sets(texts.slice(i, 500).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array([n for n, _ in sets], pa.int64()), pa.array([s for _, s in sets], pa.int64())], names=["doc_id", "th", "n_shingles", "sid"])
    release()


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, sid, group, th) of each row: exact components at similarity 0.75 over 5-word shingles.

    Rows with equal sets link; rows without words link with nothing and are their own component;
    component_id is the smallest doc_id of the component (null ids count only where there is no
    other). n_shingles counts 64-bit hashes. Links compare 48 bits, so two different n-grams of a
    pair are taken for one with chances of about 1e-8 for pairs of a thousand n-grams. ``sid``
    names the set, ``group`` its component, ``th`` the text.
    """
    kind = df.schema[doc_id].dataType.simpleString()
    groups = linked_sets(df, text)
    ids = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("th")).mapInArrow(_named, f"doc_id {kind}, th bigint, n_shingles bigint, sid bigint")
    ids = _written(ids, "named")
    keyed = ids.join(groups.withColumnRenamed("sid", "node"), F.col("sid") == F.col("node"), "left").withColumn("group", F.coalesce("root", "sid"))
    keyed = _written(keyed.select("doc_id", "th", "n_shingles", "sid", "group"), "grouped")
    # written, so that the hot group's side of the join has an exchange of its own, which Spark can split
    least = keyed.filter("group IS NOT NULL").groupBy(F.col("group").alias("of")).agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("members")).filter("members > 1")
    least = _written(least, "least")
    out = keyed.join(least, F.col("group") == F.col("of"), "left")
    discard(ids)
    return out.select("doc_id", "n_shingles", F.when(F.col("of").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"), "sid", "group", "th")


def keep_one(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of near duplicates, with the columns of ``df``: that with the smallest doc_id.

    Among rows with this id in a group, the smallest set name, then the smallest hash of the text
    decides, then the other columns that can be sorted; rows equal in all of them are
    interchangeable. Rows without words stay. What goes is told by (id, hash of the text): up to
    500,000 such keys are broadcast and texts stay where they are; more are joined by id.
    """
    from pyspark.sql.window import Window

    found = _written(near_duplicates(df, doc_id, text), "found")
    # every group has one row to keep: the first by (doc_id, set, text), nulls last
    best = found.filter("group IS NOT NULL").groupBy(F.col("group").alias("g")).agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "sid", "th")).alias("b"), F.count(F.lit(1)).alias("m"))
    best = _written(best.filter("m > 1").drop("m"), "best")
    goes = found.join(best, F.col("group") == F.col("g")).filter(~(F.col("doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("th") == F.col("b.th"))))
    again = found.filter("sid IS NOT NULL").groupBy("doc_id", "th").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    key, of, th, out = (unused(df, n) for n in ("near_key", "near_id", "near_th", "near_out"))
    touched = goes.select("doc_id", "th", F.lit(True).alias("o")).unionByName(again.select("doc_id", "th", F.lit(False).alias("o")))
    touched = _written(touched.groupBy("doc_id", "th").agg(F.max("o").alias("o")).select(F.col("doc_id").alias(of), F.col("th").alias(th), F.col("o").alias(out)), "touched")
    few = F.broadcast if touched.count() <= FEW else (lambda d: d)
    joined = df.withColumn(key, F.xxhash64(text)).join(few(touched), F.col(doc_id).eqNullSafe(F.col(of)) & (F.col(key) == F.col(th)), "left")
    single = joined.filter(F.col(out).isNull()).select(*df.columns)
    order = [F.col(f.name) for f in df.schema.fields if f.dataType.typeName() not in ("map", "variant", "void")]
    twice = joined.filter(~F.col(out)).withColumn(out, F.row_number().over(Window.partitionBy(doc_id, key).orderBy(*order)))
    discard(best)
    return single.unionByName(twice.filter(F.col(out) == 1).select(*df.columns))
