"""Distributed positional helpers: row index, contiguous folds, average ranks.

A global ``row_number()`` / ``ntile()`` without a partition runs in a single
task.  Here the rows are range-partitioned on the order key, each partition
is counted (one row per partition), the per-partition offsets are computed
on that tiny table and broadcast back.  Work stays parallel; only
``numPartitions`` numbers reach the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, shuffle_partitions


def with_row_index(df: DataFrame, order_cols, index_col: str = "row_idx",
                   num_partitions: int | None = None) -> DataFrame:
    """Add a 0-based dense position in ``order_cols`` order (keys must be unique
    for a deterministic result; ties are broken by the remaining columns'
    partition order)."""
    if isinstance(order_cols, str):
        order_cols = [order_cols]
    spark = df.sparkSession
    p = num_partitions or shuffle_partitions(spark)
    # Range bounds come from sampling and row order inside a partition from
    # the upstream plan; both must be identical for the counting pass and the
    # indexing pass, so the ranged rows are checkpointed once (reliable
    # checkpoint in the shared spark.checkpoint.dir; also cuts the lineage).
    ranged = (df.repartitionByRange(p, *order_cols)
                .sortWithinPartitions(*order_cols)
                .withColumn("_pid", F.spark_partition_id())
                .withColumn("_local", F.monotonically_increasing_id()
                            - F.shiftleft(F.spark_partition_id().cast("long"), 33)))
    ensure_checkpoint_dir(spark)
    ranged = ranged.checkpoint(eager=True)
    counts = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n")).collect()
    offsets, run = [], 0
    for row in sorted(counts, key=lambda r: r["_pid"]):
        offsets.append((row["_pid"], run))
        run += row["_n"]
    if offsets:
        off_df = spark.createDataFrame(offsets, "_pid int, _off long")
    else:
        off_df = spark.createDataFrame([], "_pid int, _off long")
    out = (ranged.join(F.broadcast(off_df), "_pid")
                 .withColumn(index_col, F.col("_off") + F.col("_local"))
                 .drop("_pid", "_local", "_off"))
    return out


def fold_starts(n: int, k: int) -> list[int]:
    """First position of folds 1 .. k-1 (F1 arithmetic: the first ``n mod k`` folds
    hold one extra row, as in an unshuffled k-fold split)."""
    q, r = divmod(n, k)
    return [f * q + min(f, r) for f in range(1, k)]


def assign_folds(df: DataFrame, order_col: str, k: int = 10, fold_col: str = "fold",
                 group_col: str | None = None) -> DataFrame:
    """add ``fold`` (0..k-1), contiguous over ``order_col`` order.

    Only the keys are ordered (and checkpointed); the k-1 keys at which a fold
    starts come back, and the fold is a column expression on the rows, which
    are not moved.  Keys must be unique; equal keys would share a fold.  With
    ``group_col`` the folds are made over distinct groups (all rows of a group
    share a fold), which keeps one text out of both train and test."""
    key = group_col or order_col
    keys = df.select(key).distinct() if group_col else df.select(key)
    idx = with_row_index(keys, key, "_row_idx")
    starts = fold_starts(idx.count(), k)
    first = {r["_row_idx"]: r[key] for r in idx.where(F.col("_row_idx").isin(starts)).collect()}
    fold = F.lit(0).cast("long")
    for s in starts:
        if s in first:            # a fold that starts beyond the last row is empty
            fold = fold + F.coalesce((F.col(key) >= F.lit(first[s])).cast("long"), F.lit(0))
    return df.withColumn(fold_col, fold)


def average_rank(df: DataFrame, col: str, rank_col: str) -> DataFrame:
    """1-based average rank of ``col`` (ties share the mean of their positions),
    computed on the distinct values so no global window is needed."""
    vals = df.groupBy(col).agg(F.count(F.lit(1)).alias("_cnt"))
    # number of rows with a smaller value = running sum of counts before this value
    # -> computed with a second distributed prefix sum over the (value, count) table
    spark = df.sparkSession
    p = shuffle_partitions(spark)
    ensure_checkpoint_dir(spark)
    ranged = (vals.repartitionByRange(p, col).sortWithinPartitions(col)
                  .withColumn("_pid", F.spark_partition_id())).checkpoint(eager=True)
    from pyspark.sql.window import Window
    w = Window.partitionBy("_pid").orderBy(col).rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumn("_before_local", F.coalesce(F.sum("_cnt").over(w), F.lit(0)))
    totals = ranged.groupBy("_pid").agg(F.sum("_cnt").alias("_tot")).collect()
    offsets, run = [], 0
    for row in sorted(totals, key=lambda r: r["_pid"]):
        offsets.append((row["_pid"], run))
        run += row["_tot"]
    off_df = spark.createDataFrame(offsets or [], "_pid int, _off long")
    ranks = (local.join(F.broadcast(off_df), "_pid")
                  .select(col, (F.col("_off") + F.col("_before_local")
                                + (F.col("_cnt") + 1) / 2.0).alias(rank_col)))
    return df.join(ranks, col)


def running_total(df: DataFrame, part_cols, order_col: str, value_col: str, out_col: str,
                  block: int | None = 4096, how: str = "sum") -> DataFrame:
    """Exclusive running sum of ``value_col`` over ``order_col`` inside each
    ``part_cols`` group, in two levels so that no task holds a whole group.

    Rows are windowed per (group, block) with block = order value div
    ``block``: one window pass gives both the in-block running sum and the
    block total.  The block totals (one row per block, rows/block per group)
    get their own running sum over blocks and are joined back on
    (group, block), which is the partitioning the rows already have, so the
    rows shuffle once.  ``order_col`` should be a dense position.

    ``block=None`` is the plain one-level window, for groups known to be
    bounded (e.g. the words of one document that arrived as one row).
    ``how='max'`` gives the running maximum of the preceding values instead
    (0 when there is none)."""
    from pyspark.sql.window import Window
    agg = {"sum": F.sum, "max": F.max}[how]
    part_cols = [part_cols] if isinstance(part_cols, str) else list(part_cols)
    if block is None:
        w = Window.partitionBy(*part_cols).orderBy(order_col).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn(out_col, F.coalesce(agg(value_col).over(w), F.lit(0)).cast("long"))
    keys = part_cols + ["_blk"]
    d = df.withColumn("_blk", F.floor(F.col(order_col) / block))
    wl = Window.partitionBy(*keys).orderBy(order_col)
    d = (d.withColumn("_local", agg(value_col).over(wl.rowsBetween(Window.unboundedPreceding, -1)))
          .withColumn("_bt", agg(value_col).over(
                          wl.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    bt = d.groupBy(*keys).agg(F.first("_bt").alias("_bt"))
    wb = Window.partitionBy(*part_cols).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    bt = bt.select(*keys, agg("_bt").over(wb).alias("_before"))
    if how == "sum":
        comb = F.coalesce(F.col("_before"), F.lit(0)) + F.coalesce(F.col("_local"), F.lit(0))
    else:
        comb = F.coalesce(F.greatest(F.col("_before"), F.col("_local")), F.lit(0))
    return (d.drop("_bt").join(bt, keys)
             .withColumn(out_col, comb.cast("long"))
             .drop("_blk", "_before", "_local"))


_APART, _ESC, _TEXTS = "\u0001", "\u0002", "_texts_"      # between joined texts; marks a sign inside a text; a column of joined texts


def _run_starts(batch, n_keys: int):
    """Places in an Arrow batch where one of the first ``n_keys`` columns changes."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc
    n = batch.num_rows
    new = np.zeros(n, bool)
    new[0] = True
    for i in range(n_keys):
        here, last = batch.column(i).slice(1), batch.column(i).slice(0, n - 1)
        other = pc.or_(pc.fill_null(pc.not_equal(here, last), False), pc.xor(pc.is_null(here), pc.is_null(last)))
        if pa.types.is_floating(here.type):
            other = pc.and_not(other, pc.fill_null(pc.and_(pc.is_nan(here), pc.is_nan(last)), False))      # equal keys in Spark
        new[1:] |= other.to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def packed_runs(df: DataFrame, key_cols: list[str], sum_col: str | None = None) -> DataFrame:
    """Rows that lie next to each other with equal keys as one row, their other columns as arrays (of one Arrow batch
    at most): far fewer bytes to shuffle than one row each where a key's rows lie together, and the same rows where they
    do not.  Texts are joined to one, with signs that ``unpacked`` knows, which takes the rows apart again.  With ``sum_col`` rows of one batch that agree in all other columns are first
    added up: ``sum_col`` is their sum, ``<sum_col>_n`` the number of values in it."""
    from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType
    cols = [c for c in df.columns if c not in key_cols and c != sum_col] + [sum_col] * (sum_col is not None)
    df = df.select(*key_cols, *cols)
    text = [df.schema[c].dataType == StringType() for c in cols]
    fields = [StructField(_TEXTS + c, StringType()) if t else StructField(c, ArrayType(df.schema[c].dataType)) for c, t in zip(cols, text)]
    fields += [StructField(f"{sum_col}_n", ArrayType(LongType()))] * (sum_col is not None)
    names, is_text = [*key_cols, *[f.name for f in fields]], [False] * len(key_cols) + text + [False]
    n_keys, agreed = len(key_cols), [*key_cols, *[c for c in cols if c != sum_col]]

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        for b in batches:
            if b.num_rows == 0:
                continue
            if sum_col is not None:
                t = pa.Table.from_batches([b]).group_by(agreed, use_threads=False).aggregate([(sum_col, "sum"), (sum_col, "count")])
                b = t.select([*agreed, f"{sum_col}_sum", f"{sum_col}_count"]).combine_chunks().to_batches()[0]
            n, first = b.num_rows, _run_starts(b, n_keys)
            bounds = pa.array(np.append(first, n), pa.int32())
            out = [b.column(i).take(pa.array(first)) for i in range(n_keys)]
            for i in range(n_keys, b.num_columns):
                values = b.column(i)
                if is_text[i]:
                    values = pc.replace_substring(pc.replace_substring(values, _ESC, _ESC + "e"), _APART, _ESC + "a")
                    values = pc.binary_join(pa.ListArray.from_arrays(bounds, pc.fill_null(values, _ESC + "n")), _APART)
                out.append(values if is_text[i] else pa.ListArray.from_arrays(bounds, values))
            yield pa.RecordBatch.from_arrays(out, names=names)

    return df.mapInArrow(run, StructType([df.schema[k] for k in key_cols] + fields))


def unpacked(df: DataFrame, key_cols: list[str]) -> DataFrame:
    """The rows that ``packed_runs`` put together; an array that is null is one of nulls."""
    def text(x):
        held = F.replace(F.replace(x, F.lit(_ESC + "a"), F.lit(_APART)), F.lit(_ESC + "e"), F.lit(_ESC))
        return F.when(x == _ESC + "n", F.lit(None)).when(F.contains(x, F.lit(_ESC)), held).otherwise(x)

    arrays = []
    for f in df.schema:
        if f.name.startswith(_TEXTS):
            arrays.append(F.coalesce(F.transform(F.split(f.name, _APART), text), F.array().cast("array<string>")).alias(f.name[len(_TEXTS):]))
        elif f.name not in key_cols:
            arrays.append(F.coalesce(F.col(f.name), F.array().cast(f.dataType)).alias(f.name))
    df = df.select(*key_cols, *arrays)
    return df.select(*key_cols, F.inline(F.arrays_zip(*[c for c in df.columns if c not in key_cols])))


#: Rows that are sorted and compressed together before they are shuffled.
ZIP_ROWS = 500_000


def zipped_parts(df: DataFrame, part_col: str, order: list[str], sum_col: str | None = None, like=None) -> DataFrame:
    """(part, zip, size): the rows of each ``part_col`` (a whole number) compressed together, up to ZIP_ROWS rows of a task at a time, sorted by ``order``: a fraction
    of the bytes to shuffle.  ``unzipped`` gives the rows back.
    With ``sum_col`` rows of a task's stretch that agree in all other columns are first added up: ``sum_col`` is their sum, ``<sum_col>_n`` the
    number of values in it.  ``like``: fields (of other rows to be unzipped together with these) that the result has; those that ``df`` lacks are null."""
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import LongType, StructField
    agreed = [c for c in df.columns if c not in (part_col, sum_col)]
    df = df.select(part_col, *agreed, *[sum_col] * (sum_col is not None))
    fields = like or [*[f for f in df.schema if f.name != part_col], *[StructField(f"{sum_col}_n", LongType())] * (sum_col is not None)]
    known = {*agreed, *([sum_col, f"{sum_col}_n"] if sum_col else [])}
    names, kinds = [f.name for f in fields], [to_arrow_type(f.dataType) for f in fields]

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        codec = pa.Codec("zstd", compression_level=3)

        def pieces(held):
            t = pa.Table.from_batches(held)
            if sum_col is not None:
                t = t.group_by([part_col, *agreed], use_threads=False).aggregate([(sum_col, "sum"), (sum_col, "count")])
                t = t.select([part_col, *agreed, f"{sum_col}_sum", f"{sum_col}_count"]).rename_columns([part_col, *agreed, sum_col, f"{sum_col}_n"])
            t = t.combine_chunks()
            t = t.take(pc.sort_indices(t, sort_keys=[(c, "ascending") for c in (part_col, *order)])).combine_chunks()
            part = t.column(0).to_numpy()
            inner = pa.Table.from_arrays([t.column(c).combine_chunks() if c in known else pa.nulls(len(t), k) for c, k in zip(names, kinds)], names=names).to_batches()[0]
            starts = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            raw = [_taken_apart(inner.slice(i, j - i), names.index(order[-1])) for i, j in zip(starts.tolist(), [*starts[1:].tolist(), len(part)])]
            return pa.RecordBatch.from_arrays([pa.array(part[starts], pa.int32()), pa.array([codec.compress(r, asbytes=True) for r in raw], pa.binary()),
                                               pa.array(list(map(len, raw)), pa.int32())], names=["part", "zip", "size"])

        held, rows = [], 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                rows += b.num_rows
            if rows >= ZIP_ROWS:
                yield pieces(held)
                held, rows = [], 0
        if held:
            yield pieces(held)

    return df.mapInArrow(run, "part int, zip binary, size int")


def _taken_apart(batch, place: int) -> bytes:
    """An Arrow batch as bytes that compress well: lengths of texts (and then the texts) for their offsets, differences for the whole numbers of the column ``place``."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc
    columns, texts = [], []
    for i, c in enumerate(batch.columns):
        if pa.types.is_string(c.type):
            columns.append(pc.binary_length(c))
            held = pc.fill_null(c, "") if c.null_count else c
            ends = np.frombuffer(held.buffers()[1], np.int32)[held.offset:held.offset + len(held) + 1]
            texts.append(held.buffers()[2].slice(ends[0], ends[-1] - ends[0]).to_pybytes() if ends[-1] > ends[0] else b"")
        elif i == place and pa.types.is_integer(c.type) and not c.null_count:
            columns.append(pa.array(np.diff(c.to_numpy(), prepend=c.to_numpy().dtype.type(0)), c.type))
        else:
            columns.append(c)
    ipc = pa.RecordBatch.from_arrays(columns, names=batch.schema.names).serialize().to_pybytes()
    return b"".join([len(ipc).to_bytes(8, "little"), ipc, *texts])


def _put_together(raw, schema, place: int):
    """The batch of ``schema`` that ``_taken_apart`` made to the buffer ``raw``."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc
    at = 8 + int.from_bytes(raw.slice(0, 8).to_pybytes(), "little")
    stored = pa.schema([(f.name, pa.int32() if pa.types.is_string(f.type) else f.type) for f in schema])
    batch = pa.ipc.read_record_batch(raw.slice(8, at - 8), stored)
    columns = []
    for i, (f, c) in enumerate(zip(schema, batch.columns)):
        if pa.types.is_string(f.type):
            ends = np.append(np.int32(0), np.cumsum(pc.fill_null(c, 0).to_numpy(), dtype=np.int32))
            size = int(ends[-1])
            valid = c.buffers()[0] if c.null_count else None
            c = pa.StringArray.from_buffers(len(c), pa.py_buffer(ends), raw.slice(at, size), valid, c.null_count)
            at += size
        elif i == place and pa.types.is_integer(f.type) and not c.null_count:
            c = pa.array(np.cumsum(c.to_numpy(), dtype=c.to_numpy().dtype), f.type)
        columns.append(c)
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def unzipped(df: DataFrame, fields, place_col: str) -> DataFrame:
    """The rows that ``zipped_parts`` compressed, which have ``fields``; ``place_col`` is the last column of their order."""
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructField, StructType
    schema = StructType([StructField(f.name, f.dataType) for f in fields])
    kinds, place = [(f.name, to_arrow_type(f.dataType)) for f in fields], [f.name for f in fields].index(place_col)

    def run(batches):
        import pyarrow as pa
        codec, inner = pa.Codec("zstd"), pa.schema(kinds)
        for b in batches:
            for raw, size in zip(b.column(1), b.column(2).to_pylist()):
                got = _put_together(codec.decompress(raw.as_buffer(), size), inner, place)
                yield from (got.slice(i, 10_000) for i in range(0, got.num_rows, 10_000))

    return df.select("part", "zip", "size").mapInArrow(run, schema)


def even_parts(spark, n: int) -> list[int]:
    """n whole numbers, each of which ``repartition(n, number)`` deals to a task of its own."""
    found: dict = {}
    end = 0
    while len(found) < n:
        rows = spark.range(end, end + 20 * n + 100).select(F.col("id").cast("int").alias("v"))
        found |= {r[0]: r[1] for r in rows.groupBy(F.pmod(F.hash("v"), F.lit(n))).agg(F.min("v")).collect() if r[0] not in found}
        end += 20 * n + 100
    return [found[i] for i in range(n)]


def group_means(df: DataFrame, key_cols: list[str], sum_col: str, out_col: str, said_col: str) -> DataFrame:
    """The rows where ``said_col`` is true, with the mean of ``sum_col`` (sums of ``<sum_col>_n`` values) over the rows of their keys as
    ``out_col``.  Rows come sorted by keys, those without ``said_col`` first, so that one pass knows each mean when it is due."""
    from pyspark.sql.types import DoubleType, StructField, StructType
    rest = [c for c in df.columns if c not in (*key_cols, sum_col, f"{sum_col}_n", said_col)]
    df = df.select(*key_cols, *rest, sum_col, f"{sum_col}_n", said_col)
    n_keys = len(key_cols)

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        last = None
        for b in batches:
            if b.num_rows == 0:
                continue
            starts = _run_starts(b, n_keys)
            total, n = (np.add.reduceat(pc.fill_null(b.column(c), 0).to_numpy(), starts) for c in (sum_col, f"{sum_col}_n"))
            if last is not None and len(_run_starts(pa.Table.from_batches([last[0], b.slice(0, 1).select(range(n_keys))]).combine_chunks().to_batches()[0], n_keys)) == 1:
                total[0] += last[1]
                n[0] += last[2]
            last = b.slice(b.num_rows - 1, 1).select(range(n_keys)), total[-1], n[-1]
            size = np.diff(np.append(starts, b.num_rows))
            mean = pa.array(np.repeat(total / np.maximum(n, 1), size), pa.float64(), mask=np.repeat(n == 0, size))
            out = pa.RecordBatch.from_arrays([*b.columns[:len(b.columns) - 3], mean], names=[*key_cols, *rest, out_col])
            yield out.filter(pc.fill_null(b.column(said_col), False))

    return df.mapInArrow(run, StructType([*[df.schema[c] for c in (*key_cols, *rest)], StructField(out_col, DoubleType())]))


def group_sums(df: DataFrame, key_cols: list[str], sum_col: str) -> DataFrame:
    """One row with the sum of ``sum_col`` for each of the keys, by which the rows come sorted."""
    df = df.select(*key_cols, sum_col)
    n_keys = len(key_cols)

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        held = None                                            # the last group may go on in the next batch
        for b in batches:
            if b.num_rows == 0:
                continue
            b = pa.RecordBatch.from_arrays(b.columns, names=b.schema.names)                  # any column may be null here
            if held is not None:
                b = pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
            starts = _run_starts(b, n_keys)
            total = pa.array(np.add.reduceat(pc.fill_null(b.column(n_keys), 0).to_numpy(), starts), b.column(n_keys).type)
            out = pa.RecordBatch.from_arrays([*[c.take(pa.array(starts)) for c in b.columns[:n_keys]], total], names=b.schema.names)
            held = out.slice(out.num_rows - 1)
            yield out.slice(0, out.num_rows - 1)
        if held is not None:
            yield held

    return df.mapInArrow(run, df.schema)


def dealt_zipped(sides: list[tuple], keys: list[str], fields) -> DataFrame:
    """Rows of all ``sides`` (rows, their order, column to add up or None), which have ``fields`` or some of them, those of equal keys in one task, compressed
    for the shuffle; the last column of the first side's order is the place."""
    spark = sides[0][0].sparkSession
    tasks = shuffle_partitions(spark)
    to = F.element_at(F.lit(even_parts(spark, tasks)), F.pmod(F.xxhash64(*keys), F.lit(tasks)).cast("int") + 1).alias("_to")
    parts = [zipped_parts(rows.select("*", to), "_to", order, sum_col, fields) for rows, order, sum_col in sides]
    return unzipped(reduce(lambda a, b: a.unionByName(b), parts).repartition(tasks, "part"), fields, sides[0][1][-1])


def looked_up(rows: DataFrame, lookup: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """``rows`` with the number ``value`` of the row of ``lookup`` that has their keys, null where there is none: a left join whose two
    sides are shuffled compressed, ``rows`` sorted by ``order``.  No key may hold a large share of the rows."""
    none = F.lit(None)
    left = rows.withColumns({"_said": F.lit(True), "_v": none.cast("double"), "_v_n": none.cast("long")})
    right = lookup.dropna(subset=keys).select(*keys, F.col(value).cast("double").alias("_v"))
    both = dealt_zipped([(left, order, None), (right, keys, "_v")], keys, left.schema)
    return group_means(both.sortWithinPartitions(*keys, "_said"), keys, "_v", value, "_said").select(*rows.columns, value)
