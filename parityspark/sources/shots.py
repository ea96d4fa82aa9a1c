"""Shot files: six encodings in, six out.

Canonical form: hits(shot_id, kind, idx) with kind M, D or L, plus shots(shot_id) for shots without hits. A
layout says how many bits of each kind a record holds; files carry no schema of their own.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import lineage
from ..shipping import ship
from .shot_source import ShotSource, session_options

TEXT_FORMATS = ("01", "hits", "dets")
PACKED_FORMATS = ("b8", "r8", "ptb64")


@dataclass(frozen=True)
class Layout:
    n_meas: int = 0
    n_det: int = 0
    n_obs: int = 0

    @property
    def bits(self) -> int:
        return self.n_meas + self.n_det + self.n_obs

    @property
    def counts(self) -> dict[str, int]:
        return {"M": self.n_meas, "D": self.n_det, "L": self.n_obs}

    def kind_of(self, pos: Column) -> Column:
        return F.when(pos < self.n_meas, "M").when(pos < self.n_meas + self.n_det, "D").otherwise("L")

    def index_of(self, pos: Column) -> Column:
        start = F.when(pos < self.n_meas, 0).when(pos < self.n_meas + self.n_det, self.n_meas).otherwise(self.n_meas + self.n_det)
        return (pos - start).cast("int")

    def position_of(self, kind: Column, idx: Column) -> Column:
        start = F.when(kind == "M", 0).when(kind == "D", self.n_meas).otherwise(self.n_meas + self.n_det)
        return (start + idx).cast("int")


def _canonical(flat: DataFrame, layout: Layout) -> DataFrame:
    return flat.select("shot_id", layout.kind_of(F.col("pos")).alias("kind"), layout.index_of(F.col("pos")).alias("idx"))


# ---- text encodings ------------------------------------------------------------------------------


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their position over all files in name order.

    A line's position is its offset inside its file split plus the lines of the splits before it; only one
    row per split is ordered, so the scan itself stays fully parallel.
    """
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_id")
    )
    splits = lines.groupBy("_f", "_b").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    before = Window.orderBy("_f", "_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select("_f", "_b", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return lines.join(offsets, ["_f", "_b"]).select((F.col("_id") - F.col("_first") + F.col("_off")).alias("shot_id"), "value")


def _checked(value: Column, bad: Column, message: str) -> Column:
    return F.when(bad, F.raise_error(F.concat(F.lit(message + ": "), F.substring(value, 1, 60))).cast("string")).otherwise(value)


def _parse_01(lines: DataFrame, layout: Layout) -> DataFrame:
    width = _checked(F.col("value"), (F.length("value") != layout.bits) | F.col("value").rlike("[^01]"), f"not a record of {layout.bits} bits")
    return lines.select("shot_id", F.posexplode(F.split(width, "")).alias("pos", "_b")).filter("_b = '1'").select("shot_id", "pos")


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once a row, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _cancelled(pos: Column) -> Column:
    """The members of an array that occur an odd number of times; a line without repeats is only looked at for them."""
    odd = lambda s, starts: F.transform(
        F.filter(starts, lambda at, i: (F.coalesce(F.get(starts, i + 1), F.size(s)) - at) % 2 == 1), lambda at: F.get(s, at)
    )
    begins = lambda s: F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, F.greatest(i - 1, F.lit(0)))))
    runs = _let(F.sort_array(pos), lambda s: _let(begins(s), lambda starts: odd(s, starts)))
    return F.when(F.size(F.array_distinct(pos)) == F.size(pos), pos).otherwise(runs)


def _hits_of(lines: DataFrame, pos: Column, layout: Layout, dedup: str) -> DataFrame:
    """Hits of lines whose positions are an array; a shot is one line, so its repeats cancel there and nothing is shuffled."""
    each = lines.select("shot_id", pos.alias("_p"))
    # Not explode: the filter that it puts below itself would parse every line a second time.
    flat = each.select("shot_id", F.explode_outer(F.col("_p") if dedup == "keep" else _cancelled(F.col("_p"))).alias("pos"))
    return _canonical(flat.filter("pos IS NOT NULL"), layout)


def _parse_hits(lines: DataFrame, layout: Layout, dedup: str) -> DataFrame:
    clean = _checked(F.trim("value"), F.trim("value").rlike("[^0-9,]"), "not a list of hits")
    fail = lambda h: F.raise_error(F.concat(F.lit("hit out of range: "), h)).cast("int")
    place = lambda h: F.when((h.cast("int") >= layout.bits) | h.cast("int").isNull(), fail(h)).otherwise(h.cast("int"))
    each = F.when(F.trim("value") == "", F.array().cast("array<string>")).otherwise(F.split(clean, ","))
    return _hits_of(lines, F.transform(each, place), layout, dedup)


def _parse_dets(lines: DataFrame, layout: Layout, dedup: str) -> DataFrame:
    # One word at a time: a pattern that repeats a group over the whole line needs a stack as deep as the line is long.
    wrong = ~F.col("value").rlike(r"^shot(\s|$)") | F.col("value").rlike(r"\s(?=\S)(?![MDL][0-9]+(\s|$))")
    clean = _checked(F.col("value"), wrong, "not a shot line")

    def place(h):
        kind, idx = F.substring(h, 1, 1), F.ltrim(h, F.lit("MDL")).cast("int")
        limit = F.coalesce(*[F.when(kind == k, F.lit(n)) for k, n in layout.counts.items()])
        fail = F.raise_error(F.concat(F.lit("index out of range: "), h)).cast("int")
        return F.when(idx >= limit, fail).otherwise(layout.position_of(kind, idx))

    return _hits_of(lines, F.transform(F.regexp_extract_all(clean, F.lit("([MDL][0-9]+)"), F.lit(1)), place), layout, dedup)


def parse_shot_lines(lines: DataFrame, fmt: str, layout: Layout, dedup: str = "xor") -> DataFrame:
    """Hits of text lines(shot_id, value) (SRC1, SRC3, SRC4).

    ``dedup='xor'`` cancels repeated indices, ``'keep'`` leaves them as written. A line is one shot.
    """
    if fmt == "01":
        return _canonical(_parse_01(lines, layout), layout)
    return {"hits": _parse_hits, "dets": _parse_dets}[fmt](lines, layout, dedup)


def shot_lines(shots: DataFrame, hits: DataFrame, fmt: str, layout: Layout) -> DataFrame:
    """Text line of every shot, those without hits included (SNK1)."""
    p = F.col("pos")
    rows = _shot_rows(shots, hits, layout)
    if fmt == "hits":
        line = F.array_join(F.transform(p, lambda i: i.cast("string")), ",")
    elif fmt == "dets":
        line = F.concat_ws(" ", F.lit("shot"), F.array_join(F.transform(p, lambda i: F.concat(layout.kind_of(i), layout.index_of(i).cast("string"))), " "))
        line = F.rtrim(line)
    elif fmt == "01":
        ones = F.transform(p, lambda i, at: F.concat(F.repeat(F.lit("0"), i - F.coalesce(F.get(p, at - 1), F.lit(-1)) - 1), F.lit("1")))
        line = F.concat(F.array_join(ones, ""), F.repeat(F.lit("0"), F.lit(layout.bits - 1) - F.coalesce(F.try_element_at(p, F.lit(-1)), F.lit(-1))))
    else:
        raise ValueError(f"{fmt!r} is not a text encoding")
    return rows.select("shot_id", line.alias("line"))


def _shot_rows(shots: DataFrame, hits: DataFrame, layout: Layout) -> DataFrame:
    """One row per shot with its sorted bit positions; a record has at most ``layout.bits`` of them."""
    marked = hits.select("shot_id", layout.position_of(F.col("kind"), F.col("idx")).alias("pos")).unionByName(
        shots.select("shot_id", F.lit(None).cast("int").alias("pos"))
    )
    return marked.groupBy("shot_id").agg(F.array_sort(F.collect_list("pos")).alias("pos"))


# ---- packed encodings ----------------------------------------------------------------------------


def _qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme: one without goes to the cluster's default file system, not to an executor's disk."""
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(p).toString()


def _source(spark: SparkSession, path: str, fmt: str, layout: Layout, **options: str):
    """Reader of the data source over packed files, with the session's split size."""
    ship(spark)
    if spark.sparkContext.applicationId not in _registered:
        spark.dataSource.register(ShotSource)
        _registered.add(spark.sparkContext.applicationId)
    return {"path": _qualified(spark, path), "encoding": fmt, "n_meas": str(layout.n_meas), "n_det": str(layout.n_det), "n_obs": str(layout.n_obs)} | session_options(spark) | options


_registered: set[str] = set()


def scan_packed(spark: SparkSession, path: str, fmt: str, layout: Layout, view: str, **options: str) -> DataFrame:
    """One of the data source's views over packed files (see ``shot_source``)."""
    return spark.read.format("shots").options(**_source(spark, path, fmt, layout, view=view, **options)).load()


def index_runs(spark: SparkSession, path: str, layout: Layout, **options: str) -> tuple[str, DataFrame]:
    """Index of run-length files, as the path of a written table, and (file, n, file_shots) of each file.

    Every byte moves the position by its value plus one (255 by 255), and every record ends one bit past its width. A first pass adds up
    how far each range moves on; running sums over these few rows say where each begins.
    """
    sums = lineage.cut(scan_packed(spark, path, "r8", layout, "advance", **options), "r8-sums")
    per_file = sums.groupBy("file").agg(F.sum("total").alias("t"))
    broken = F.raise_error(F.concat(F.lit("last record is incomplete: "), "file")).cast("bigint")
    files_before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    record = layout.bits + 1
    shots = per_file.select("file", F.when(F.col("t") % record != 0, broken).otherwise(F.floor(F.col("t") / record)).alias("n"))
    shots = shots.select("file", "n", F.coalesce(F.sum("n").over(files_before), F.lit(0)).alias("file_shots"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    index = lineage.new_path(spark, "r8-index")
    placed = sums.withColumn("at", F.coalesce(F.sum("total").over(before), F.lit(0))).join(shots, "file")
    placed.select("file", "start", "size", "at", "file_shots").write.parquet(index)
    return _qualified(spark, index), shots


def write_shots_packed(shots: DataFrame, hits: DataFrame, path: str, fmt: str, layout: Layout, overwrite: bool = False) -> DataFrame:
    """Write byte-encoded files, one per task, and return (file, shots, bytes) (SNK2).

    Files are named by their first shot, so name order is shot order, and appear together when the job commits. ptb64 packs 64 shots
    together: ids must then be 0, 1, 2, ...; the last group is padded with empty shots. A folder in use is refused unless overwritten.
    """
    spark = shots.sparkSession
    step = 64 if fmt == "ptb64" else 1
    ordered = _shot_rows(shots, hits, layout).withColumn("_g", F.floor(F.col("shot_id") / step)).repartitionByRange("_g").sortWithinPartitions("shot_id").drop("_g")
    try:
        ordered.write.format("shots").options(**_source(spark, path, fmt, layout)).mode("overwrite" if overwrite else "append").save()
    except Exception as failed:
        if "already holds files" in str(failed):
            raise FileExistsError(f"{path} already holds files") from failed
        raise
    return scan_packed(spark, path, fmt, layout, "files")


# ---- front ends ----------------------------------------------------------------------------------


def read_shots(spark: SparkSession, path: str, fmt: str, layout: Layout, dedup: str = "xor", **options: str) -> DataFrame:
    """Hits (shot_id, kind, idx) of shot files in any encoding (SRC1 - SRC6); shots are numbered in file order.

    ``options`` go to the data source of packed files, such as ``split_bytes``.
    """
    if fmt in TEXT_FORMATS:
        return parse_shot_lines(read_lines(spark, path), fmt, layout, dedup)
    if fmt == "r8":
        options["index"] = index_runs(spark, path, layout, **options)[0]
    return scan_packed(spark, path, fmt, layout, "hits", **options)


#: Bytes a row for the table function: Spark hands it 100 rows at a time and keeps all that they return.
TABLE_PIECE = 2048


def table_pieces(spark: SparkSession, path: str, fmt: str, layout: Layout) -> DataFrame:
    """Pieces (first_shot, content) of packed files as small as a table function needs them."""
    return scan_packed(spark, path, fmt, layout, "chunks", piece_bytes=str(TABLE_PIECE))


class DecodeB8:
    """Table function over a piece of a packed file: a row (shot, pos) for every set bit (UDTF1)."""

    def eval(self, content: bytes, bits: int):
        data = np.frombuffer(content, dtype=np.uint8).reshape(-1, (bits + 7) // 8)
        for first in range(0, len(data), 4096):
            shot, pos = np.nonzero(np.unpackbits(data[first : first + 4096], axis=1, bitorder="little")[:, :bits])
            yield from zip((shot + first).tolist(), pos.tolist())


def register_functions(spark: SparkSession) -> None:
    """Make ``decode_b8(content, bits)`` available to SQL, for use with ``table_pieces``."""
    ship(spark)
    spark.udtf.register("decode_b8", F.udtf(DecodeB8, returnType="shot bigint, pos int"))


def write_shots(shots: DataFrame, hits: DataFrame, path: str, fmt: str, layout: Layout) -> None:
    """Write shot files in shot order (SNK1, SNK2)."""
    if fmt in TEXT_FORMATS:
        shot_lines(shots, hits, fmt, layout).sort("shot_id").select("line").write.text(path)
    else:
        write_shots_packed(shots, hits, path, fmt, layout)


def count_shots(spark: SparkSession, path: str, fmt: str, layout: Layout) -> DataFrame:
    """Shots of the files, including those without hits; padding shots of ptb64 count too."""
    if fmt in TEXT_FORMATS:
        return read_lines(spark, path).select("shot_id")
    if fmt == "r8":
        files = index_runs(spark, path, layout)[1].filter("n > 0")
        return files.select(F.explode(F.sequence("file_shots", F.col("file_shots") + F.col("n") - 1)).alias("shot_id"))
    ranges = scan_packed(spark, path, fmt, layout, "ranges")
    return ranges.select(F.explode(F.sequence("first_shot", F.col("first_shot") + F.col("shots") - 1)).alias("shot_id"))


def convert_shots(
    spark: SparkSession, src: str, src_fmt: str, dst: str, dst_fmt: str, layout: Layout, shots: DataFrame | None = None,
    append_obs: bool = False, prepend_obs: bool = False, obs_out: str | None = None,
) -> None:
    """Re-encode shot files (SNK3). Observables stay as they are, or exactly one of: go behind the detectors,
    in front of them, or into a second file set."""
    if append_obs + prepend_obs + (obs_out is not None) > 1:
        raise ValueError("observables can be appended, prepended or split off, not more than one of these")
    hits = read_shots(spark, src, src_fmt, layout)
    shots = count_shots(spark, src, src_fmt, layout) if shots is None else shots
    det, obs = hits.filter("kind <> 'L'"), hits.filter("kind = 'L'")
    as_det = lambda df, kind, shift: df.select("shot_id", F.lit("D").alias("kind"), (F.col("idx") + shift).alias("idx")) if kind else df
    if obs_out is not None:
        write_shots(shots, obs, obs_out, dst_fmt, Layout(n_obs=layout.n_obs))
        write_shots(shots, det, dst, dst_fmt, Layout(layout.n_meas, layout.n_det, 0))
    elif append_obs or prepend_obs:
        wide = Layout(layout.n_meas, layout.n_det + layout.n_obs, 0)
        if append_obs:
            moved = det.unionByName(as_det(obs, "D", layout.n_det))
        else:
            only = det.filter("kind = 'D'")
            moved = det.filter("kind = 'M'").unionByName(as_det(only, "D", layout.n_obs)).unionByName(as_det(obs, "D", 0))
        write_shots(shots, moved, dst, dst_fmt, wide)
    else:
        write_shots(shots, hits, dst, dst_fmt, layout)
