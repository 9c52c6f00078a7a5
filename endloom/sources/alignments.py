"""Alignment records: SAM text by Spark's reader, BAM and FASTQ by Python data sources, PAF
with cs.

The record columns are name, flag, chrom, start (0-based), mapq, cigar, seq, quals, tags.
A BAM file is cut into byte ranges, and each is read by a task of its own: a record belongs
to the range in which its first block begins, so it is read once, and no task holds more
than a few blocks. Files are opened by pyarrow's file systems, so any store that these know
will do.
"""

from __future__ import annotations

import glob
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.window import Window

from ..functions import sequence as S
from ..functions.kernels import CIGAR

SCHEMA = "name string, flag int, chrom string, start long, mapq int, cigar string, seq string, quals string, tags map<string,string>"


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Alignment lines of SAM text; header lines are skipped."""
    return sam_records(spark.read.text(path))


def stream_sam(spark: SparkSession, path: str, files_at_once: int = 8) -> DataFrame:
    """The same as a stream of the SAM files that come into a folder: the filters and columns of
    this module serve both, and a checkpoint makes a stream resume where it stopped."""
    return sam_records(spark.readStream.option("maxFilesPerTrigger", files_at_once).text(path))


def sam_records(text: DataFrame) -> DataFrame:
    cells = F.split("value", "\t")
    get = lambda i: F.get(cells, F.lit(i))
    lines = text.where(~F.col("value").startswith("@") & (F.size(cells) >= 11))
    tags = F.transform(F.slice(cells, 12, F.greatest(F.size(cells) - 11, F.lit(0))), lambda t: F.struct(F.substring(t, 1, 2).alias("k"), F.regexp_replace(t, "^..:.:", "").alias("v")))
    return lines.select(
        get(0).alias("name"), get(1).try_cast("int").alias("flag"), get(2).alias("chrom"), (get(3).try_cast("long") - 1).alias("start"),
        get(4).try_cast("int").alias("mapq"), get(5).alias("cigar"), get(9).alias("seq"), get(10).alias("quals"), F.map_from_entries(tags).alias("tags"),
    )


def primary(records: DataFrame) -> DataFrame:
    """Mapped records that are neither secondary nor supplementary."""
    return records.where(F.col("flag").bitwiseAND(0x904) == 0)


def read_table(records: DataFrame) -> DataFrame:
    """Adds strand, end, ops, junctions, clips and the ends along the strand."""
    r = records.withColumns({"strand": F.when(F.col("flag").bitwiseAND(16) == 0, "+").otherwise("-"), "ops": S.cigar_ops(F.col("cigar"))})
    r = r.withColumn("end", S.reference_end(F.col("start"), F.col("ops"))).withColumn("clips", S.clip_lengths(F.col("ops"), F.col("strand")))
    return r.withColumns({"junctions": S.junctions(F.col("start"), F.col("ops")), "three_prime": S.three_prime(F.col("start"), F.col("end"), F.col("strand")), "five_prime": S.five_prime(F.col("start"), F.col("end"), F.col("strand"))})


def extract(reads: DataFrame, region: tuple[str, int, int] | None = None, min_mapq: int = 0, min_length: int = 0, strand: str | None = None, spliced_only: bool = False) -> DataFrame:
    """Conjunctive filters on read_table() rows."""
    out = reads.where((F.col("mapq") >= min_mapq) & (F.col("end") - F.col("start") >= min_length))
    if region:
        chrom, start, end = region
        out = out.where((F.col("chrom") == chrom) & (F.col("start") < end) & (F.col("end") > start))
    if strand:
        out = out.where(F.col("strand") == strand)
    return out.where(F.size("junctions") > 0) if spliced_only else out


def cs_to_cigar(cs: Column) -> Column:
    """A CIGAR string from the long form of a cs tag: =ACGT, *xy, +seq, -seq, ~gt12ag; runs of
    matches and mismatches become one M."""
    tokens = F.regexp_extract_all(cs, F.lit(r"(=[A-Za-z]+|\*[a-z]{2}|\+[a-z]+|-[a-z]+|~[a-z]{2}[0-9]+[a-z]{2}|:[0-9]+)"), F.lit(1))
    op = lambda t: F.when(t.rlike("^[=*:]"), "M").when(t.startswith("+"), "I").when(t.startswith("-"), "D").otherwise("N")
    size = lambda t: F.when(t.startswith("*"), 1).when(t.startswith(":"), F.regexp_replace(t, "^:", "").cast("long")).when(t.startswith("~"), F.regexp_extract(t, "([0-9]+)", 1).cast("long")).otherwise(F.length(t) - 1)
    each = F.transform(tokens, lambda t: F.struct(op(t).alias("op"), size(t).cast("long").alias("len")))
    merged = F.aggregate(
        each,
        F.expr("CAST(array() AS array<struct<op:string,len:bigint>>)"),
        lambda acc, t: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["op"] == t["op"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(t["op"].alias("op"), (F.element_at(acc, -1)["len"] + t["len"]).alias("len"))))).otherwise(F.concat(acc, F.array(t))),
    )
    return F.array_join(F.transform(merged, lambda t: F.concat(t["len"].cast("string"), t["op"])), "")


def read_paf(spark: SparkSession, path: str) -> DataFrame:
    """PAF lines with cs tags: name, strand, chrom, start, end, mapq, cigar, and is_primary for
    the best of a read (mapping quality, then length, then place)."""
    cells = F.split("value", "\t")
    cs = F.regexp_extract("value", r"\tcs:Z:([^\t]*)", 1)
    get = lambda i: F.get(cells, F.lit(i))
    rows = spark.read.text(path).where(F.size(cells) >= 12).select(get(0).alias("name"), get(4).alias("strand"), get(5).alias("chrom"), get(7).try_cast("long").alias("start"), get(8).try_cast("long").alias("end"), get(11).try_cast("int").alias("mapq"), cs_to_cigar(cs).alias("cigar"), get(2).try_cast("long").alias("q_before"), (get(1).try_cast("long") - get(3).try_cast("long")).alias("q_after"))
    w = Window.partitionBy("name").orderBy(F.col("mapq").desc(), (F.col("end") - F.col("start")).desc(), "chrom", "start")
    return rows.withColumn("is_primary", F.row_number().over(w) == 1)


def paf_records(paf: DataFrame, reads: DataFrame) -> DataFrame:
    """Records of SCHEMA's columns from read_paf() rows and their reads (name, seq, quals):
    reverse strand 16, secondary 256; bases outside the alignment are soft-clipped where the
    PAF row says how many."""
    minus = F.col("strand") == "-"
    r = paf.join(reads.select("name", "seq", "quals"), "name", "left")
    flag = F.when(minus, 16).otherwise(0) + F.when(F.col("is_primary"), 0).otherwise(256)
    seq = F.when(minus, S.revcomp(F.col("seq"))).otherwise(F.col("seq"))
    quals = F.when(minus, F.reverse("quals")).otherwise(F.col("quals"))
    left, right = F.when(minus, F.col("q_after")).otherwise(F.col("q_before")), F.when(minus, F.col("q_before")).otherwise(F.col("q_after"))
    clip = lambda n: F.when(n > 0, F.concat(n.cast("string"), F.lit("S"))).otherwise("")
    cigar = F.concat(clip(left), F.col("cigar"), clip(right))
    return r.select("name", flag.cast("int").alias("flag"), "chrom", "start", "mapq", cigar.alias("cigar"), F.coalesce(seq, F.lit("*")).alias("seq"), F.coalesce(quals, F.lit("*")).alias("quals"), F.expr("CAST(map() AS map<string,string>)").alias("tags"))


_SEQ = "=ACMGRSVTWYHKDBN"
_OPS = "MIDNSHP=X"


#: Bytes of a file that one task reads.
SPLIT = 64 << 20


def _open(path: str):
    """(file system, path in it) of a URI or a local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else fs.FileSystem.from_uri(f"file://{os.path.abspath(path)}")


def files_of(path: str, suffix: str = "") -> list[tuple[str, int]]:
    """(path, size) of a file, of the files of a folder, or of a local pattern."""
    from pyarrow import fs

    scheme = path.partition("://")[0] + "://" if "://" in path else ""
    paths = sorted(glob.glob(path)) if not scheme and glob.has_magic(path) else [path]
    out = []
    for p in paths:
        system, at = _open(p)
        info = system.get_file_info(at)
        if info.type == fs.FileType.Directory:
            inner = system.get_file_info(fs.FileSelector(at, recursive=True))
            out += [((scheme if scheme != "file://" else "") + f.path, f.size) for f in inner if f.type == fs.FileType.File and f.path.endswith(suffix) and not os.path.basename(f.path).startswith(("_", "."))]
        elif info.type == fs.FileType.File:
            out.append((p, info.size))
        else:
            raise FileNotFoundError(p)
    return sorted(out)


class Blocks:
    """The inflated blocks of a BGZF file, from a byte offset that need not be a block's."""

    def __init__(self, file, at: int, size: int) -> None:
        self.file, self.at, self.size = file, at, size

    def _header(self, at: int) -> int | None:
        """Bytes of the block that begins at an offset; None if none does."""
        if at + 18 > self.size:
            return None
        self.file.seek(at)
        head = self.file.read(18)
        if head[:4] != b"\x1f\x8b\x08\x04" or head[12:16] != b"BC\x02\x00":
            return None
        return struct.unpack_from("<H", head, 16)[0] + 1

    def seek(self) -> None:
        """Moves to the first block at or after the offset: one that others follow."""
        while self.at < self.size:
            self.file.seek(self.at)
            raw = self.file.read(1 << 17)
            found = -1
            while (found := raw.find(b"\x1f\x8b\x08\x04", found + 1)) >= 0:
                at, n = self.at + found, 0
                while at < self.size and n < 3 and (length := self._header(at)):
                    at, n = at + length, n + 1
                if n == 3 or at == self.size:
                    self.at += found
                    return
            self.at += max(len(raw) - 3, 1) if len(raw) == 1 << 17 else len(raw)

    def next(self) -> bytes | None:
        length = self._header(self.at)
        if length is None:
            return None
        self.file.seek(self.at)
        raw = self.file.read(length)
        self.at += length
        extra = struct.unpack_from("<H", raw, 10)[0]
        return zlib.decompress(raw[12 + extra : length - 8], -15)


def _tags(raw: bytes) -> dict[str, str]:
    out, at = {}, 0
    sizes = {"c": ("<b", 1), "C": ("<B", 1), "s": ("<h", 2), "S": ("<H", 2), "i": ("<i", 4), "I": ("<I", 4), "f": ("<f", 4)}
    while at + 3 <= len(raw):
        key, kind = raw[at : at + 2].decode(), chr(raw[at + 2])
        at += 3
        if kind in "ZH":
            end = raw.index(0, at)
            out[key], at = raw[at:end].decode(), end + 1
        elif kind == "A":
            out[key], at = chr(raw[at]), at + 1
        elif kind == "B":
            fmt, width = sizes[chr(raw[at])]
            n = struct.unpack_from("<I", raw, at + 1)[0]
            out[key] = ",".join(str(struct.unpack_from(fmt, raw, at + 5 + k * width)[0]) for k in range(n))
            at += 5 + n * width
        else:
            fmt, width = sizes[kind]
            out[key], at = str(struct.unpack_from(fmt, raw, at)[0]), at + width
    return out


def _record(raw: bytes, at: int, names: list[str]) -> tuple:
    """The record at an offset, in the order of SCHEMA."""
    size, ref, pos, l_name, mapq, _, n_cigar, flag, l_seq = struct.unpack_from("<iiiBBHHHi", raw, at)
    body, end = at + 36, at + 4 + size
    name = raw[body : body + l_name - 1].decode()
    body += l_name
    cigar = "".join(f"{v >> 4}{_OPS[v & 15]}" for v in struct.unpack_from(f"<{n_cigar}I", raw, body))
    body += 4 * n_cigar
    seq = "".join(_SEQ[b >> 4] + _SEQ[b & 15] for b in raw[body : body + (l_seq + 1) // 2])[:l_seq]
    body += (l_seq + 1) // 2
    quals = "*" if not l_seq or raw[body] == 0xFF else bytes(q + 33 for q in raw[body : body + l_seq]).decode()
    return name, flag, names[ref] if ref >= 0 else "*", pos, mapq, cigar or "*", seq or "*", quals, _tags(raw[body + l_seq : end])


def _plausible(raw: bytes, at: int, refs: int) -> int | None:
    """Where the record after one that may begin at an offset begins; None if none can."""
    if at + 36 > len(raw):
        return None
    size, ref, pos, l_name, _, _, n_cigar, _, l_seq, mate, mate_pos = struct.unpack_from("<iiiBBHHHiii", raw, at)
    if not (32 < size < 1 << 24 and -1 <= ref < refs and -1 <= mate < refs and pos >= -1 and mate_pos >= -1 and l_name > 1 and 0 <= l_seq):
        return None
    if 32 + l_name + 4 * n_cigar + (l_seq + 1) // 2 + l_seq > size:
        return None
    name = raw[at + 36 : at + 36 + l_name]
    if len(name) == l_name and (name[-1] or not all(33 <= c < 127 for c in name[:-1])):
        return None
    cigar = raw[at + 36 + l_name : at + 36 + l_name + 4 * n_cigar]
    return None if any(c & 15 > 8 for c in cigar[::4]) else at + 4 + size


def bam_references(path: str) -> tuple[list[tuple[str, int]], int]:
    """(name, length) of each reference in a BAM file's header, and the inflated size of the
    header."""
    system, at = _open(path)
    with system.open_input_file(at) as f:
        blocks, raw = Blocks(f, 0, f.size()), b""

        def need(n: int) -> None:
            nonlocal raw
            while len(raw) < n:
                more = blocks.next()
                if more is None:
                    raise ValueError(f"{path}: the header is cut off")
                raw += more

        need(8)
        if raw[:4] != b"BAM\x01":
            raise ValueError(f"{path} is no BAM file")
        at = 8 + struct.unpack_from("<i", raw, 4)[0]
        need(at + 4)
        n = struct.unpack_from("<i", raw, at)[0]
        at += 4
        out = []
        for _ in range(n):
            need(at + 4)
            size = struct.unpack_from("<i", raw, at)[0]
            need(at + 8 + size)
            out.append((raw[at + 4 : at + 3 + size].decode(), struct.unpack_from("<i", raw, at + 4 + size)[0]))
            at += 8 + size
        return out, at


def read_range(path: str, begin: int, end: int, names: list[str], header: int) -> Iterator[tuple]:
    """The records whose first block begins in a range of bytes of a BAM file."""
    system, where = _open(path)
    with system.open_input_file(where) as f:
        blocks = Blocks(f, begin, f.size())
        if begin:
            blocks.seek()
        raw, marks = b"", []  # marks: (place in raw, offset in the file) of each block held

        def more() -> bool:
            nonlocal raw
            at = blocks.at
            data = blocks.next()
            if data is None:
                return False
            marks.append((len(raw), at))
            raw += data
            return True

        if begin >= blocks.size or blocks.at >= end or not more():
            return
        at = 0 if begin else header
        while at > len(raw) and more():
            pass
        def follows(step: int) -> bool:
            """Whether four records, or all to the end of the file, follow one another."""
            for n in range(4):
                while len(raw) < step + 320 and more():
                    pass
                if step == len(raw):
                    return n > 0
                following = _plausible(raw, step, len(names))
                if following is None:
                    return False
                while len(raw) < following and more():
                    pass
                if len(raw) < following:
                    return False
                step = following
            return True

        if begin:  # the first place from which records follow one another
            while not follows(at):
                at += 1
                if at + 36 > len(raw) and not more():
                    return
        while True:
            while len(raw) < at + 4 and more():
                pass
            if len(raw) < at + 4:
                return
            if next(offset for place, offset in reversed(marks) if place <= at) >= end:
                return
            size = struct.unpack_from("<i", raw, at)[0]
            while len(raw) < at + 4 + size:
                if not more():
                    raise ValueError(f"{path}: the last record is cut off")
            yield _record(raw, at, names)
            at += 4 + size
            if at > 1 << 20:  # let go of what is read
                held = max(k for k, (place, _) in enumerate(marks) if place <= at)
                base = marks[held][0]
                raw, at, marks = raw[base:], at - base, [(place - base, offset) for place, offset in marks[held:]]


def read_bam(spark: SparkSession, path: str, split: int = SPLIT, region: tuple[str, int, int] | None = None) -> DataFrame:
    """BAM files, a folder of them or a pattern, in ranges of about so many bytes. region:
    only records that start in it, so that disjoint regions share no record."""
    register(spark)
    records = spark.read.format("bam").option("split", split).load(path)
    return records if region is None else starting_in(records, *region)


def starting_in(records: DataFrame, chrom: str, start: int, end: int) -> DataFrame:
    """Records that start in [start, end): a read on a border belongs to one region."""
    return records.where((F.col("chrom") == chrom) & (F.col("start") >= start) & (F.col("start") < end))


@dataclass
class _Range(InputPartition):
    path: str
    begin: int
    end: int


class BamSource(DataSource):
    """spark.read.format("bam").load(path), and df.write.format("bam").option("references",
    "chr1:1000,chr2:500").save(path) for frames of SCHEMA's columns."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _BamReader(self.options["path"], int(self.options.get("split", SPLIT)))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _BamWriter(self.options["path"], self.options["references"], overwrite, [f.name for f in schema.fields])


def _ranges(path: str, split: int, suffix: str) -> list[InputPartition]:
    return [_Range(p, at, min(at + split, size)) for p, size in files_of(path, suffix) for at in range(0, max(size, 1), split)]


class _BamReader(DataSourceReader):
    def __init__(self, path: str, split: int) -> None:
        self.path, self.split = path, split

    def partitions(self) -> list[InputPartition]:
        return _ranges(self.path, self.split, ".bam")

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        references, header = bam_references(partition.path)
        yield from read_range(partition.path, partition.begin, partition.end, [n for n, _ in references], header)


_CODES = {c: i for i, c in enumerate(_SEQ)}


def encode_record(row: tuple, refs: dict[str, int]) -> bytes:
    """A record of SCHEMA's values as BAM bytes. Tags that read as integers or as decimals
    take those types, others are text."""
    name, flag, chrom, start, mapq, cigar, seq, quals, tags = row
    ops = [(int(n) << 4) | _OPS.index(o) for n, o in CIGAR.findall(cigar or "")]
    seq = "" if seq in (None, "*") else seq
    codes = [_CODES.get(c, 15) for c in seq.upper()] + [0] * (len(seq) % 2)
    packed = bytes(codes[i] << 4 | codes[i + 1] for i in range(0, len(codes), 2))
    shown = b"\xff" * len(seq) if quals in (None, "*") else bytes(ord(c) - 33 for c in quals)
    extra = b""
    for key, value in (tags or {}).items():
        if re.fullmatch("-?[0-9]{1,9}", value):
            extra += key.encode() + b"i" + struct.pack("<i", int(value))
        elif re.fullmatch(r"-?[0-9]+\.[0-9]+", value):
            extra += key.encode() + b"f" + struct.pack("<f", float(value))
        else:
            extra += key.encode() + b"Z" + value.encode() + b"\0"
    label = (name or "*").encode() + b"\0"
    ref = refs.get(chrom, -1)
    start = -1 if start is None else start
    length = sum(v >> 4 for v in ops if _OPS[v & 15] in "MDN=X") or 1
    body = struct.pack("<iiBBHHHiiii", ref, start, len(label), mapq or 0, _bin(max(start, 0), max(start, 0) + length), len(ops), flag or 0, len(seq), -1, -1, 0)
    body += label + struct.pack(f"<{len(ops)}I", *ops) + packed + shown + extra
    return struct.pack("<i", len(body)) + body


def _bin(start: int, end: int) -> int:
    """The bin of the format's index that holds an interval: the smallest of its six levels."""
    for level, shift in ((5, 14), (4, 17), (3, 20), (2, 23), (1, 26)):
        if start >> shift == (end - 1) >> shift:
            return ((1 << 3 * level) - 1) // 7 + (start >> shift)
    return 0


def bgzf_block(data: bytes) -> bytes:
    packed = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packed.compress(data) + packed.flush()
    return b"\x1f\x8b\x08\x04" + bytes(4) + b"\x00\xff\x06\x00BC\x02\x00" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def bam_header(references: list[tuple[str, int]]) -> bytes:
    text = "@HD\tVN:1.6\n" + "".join(f"@SQ\tSN:{n}\tLN:{size}\n" for n, size in references)
    out = b"BAM\x01" + struct.pack("<i", len(text)) + text.encode() + struct.pack("<i", len(references))
    for n, size in references:
        out += struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", size)
    return out


@dataclass
class _Written(WriterCommitMessage):
    temporary: str
    final: str


class _BamWriter(DataSourceWriter):
    """One file a partition, under a name of its own until the job commits, so that a task
    that is run again leaves nothing behind."""

    def __init__(self, path: str, references: str, overwrite: bool, names: list[str]) -> None:
        self.path, self.overwrite, self.job = path.rstrip("/"), overwrite, uuid.uuid4().hex[:12]
        self.references = [(r.rsplit(":", 1)[0], int(r.rsplit(":", 1)[1])) for r in references.split(",")]
        self.order = [names.index(f.split()[0]) for f in SCHEMA.split(", ")]

    def write(self, rows: Iterator[tuple]) -> WriterCommitMessage:
        from pyspark import TaskContext

        task = TaskContext.get()
        system, folder = _open(self.path)
        system.create_dir(folder, recursive=True)
        final = f"part-{task.partitionId():05d}-{self.job}.bam"
        temporary = f"_{final}-{task.taskAttemptId()}"
        refs = {n: i for i, (n, _) in enumerate(self.references)}
        with system.open_output_stream(f"{folder}/{temporary}") as f:
            held = bam_header(self.references)
            for row in rows:
                held += encode_record(tuple(row[i] for i in self.order), refs)
                while len(held) >= 0xFF00:
                    f.write(bgzf_block(held[:0xFF00]))
                    held = held[0xFF00:]
            if held:
                f.write(bgzf_block(held))
            f.write(bgzf_block(b""))
        return _Written(temporary, final)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        from pyarrow import fs

        system, folder = _open(self.path)
        if self.overwrite:
            for f in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
                if f.path.endswith(".bam") and self.job not in f.path:
                    system.delete_file(f.path)
        for m in messages:
            if m is not None:
                system.move(f"{folder}/{m.temporary}", f"{folder}/{m.final}")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, folder = _open(self.path)
        for m in messages:
            if m is not None:
                system.delete_file(f"{folder}/{m.temporary}")


def write_bam(records: DataFrame, path: str, references: list[tuple[str, int]], by_place: bool = True) -> None:
    """Records of SCHEMA's columns as a folder of BAM files; by_place: each sorted and the
    files in order of (reference, start)."""
    register(records.sparkSession)
    out = records.select(*[f.split()[0] for f in SCHEMA.split(", ")])
    if by_place:
        order = F.coalesce(F.array_position(F.array(*[F.lit(n) for n, _ in references]), F.col("chrom")), F.lit(0)).cast("int")
        out = out.withColumn("__o", F.when(order == 0, len(references) + 1).otherwise(order)).repartitionByRange("__o", "start").sortWithinPartitions("__o", "start").drop("__o")
    out.write.format("bam").option("references", ",".join(f"{n}:{size}" for n, size in references)).mode("overwrite").save(path)


class FastqSource(DataSource):
    """spark.read.format("fastq").load(path): name, seq, quals, complete of four-line records,
    in ranges of bytes; gzip files are one range each."""

    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return "name string, seq string, quals string, complete boolean"

    def reader(self, schema) -> DataSourceReader:
        return _FastqReader(self.options["path"], int(self.options.get("split", SPLIT)))


class _FastqReader(DataSourceReader):
    def __init__(self, path: str, split: int) -> None:
        self.path, self.split = path, split

    def partitions(self) -> list[InputPartition]:
        out = []
        for p, size in files_of(self.path):
            step = size + 1 if p.endswith(".gz") else self.split
            out += [_Range(p, at, min(at + step, size)) for at in range(0, max(size, 1), step)]
        return out

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import gzip

        system, where = _open(partition.path)
        with system.open_input_file(where) as raw:
            if partition.path.endswith(".gz"):
                yield from _fastq_records(gzip.GzipFile(fileobj=raw), 0, None)
            else:
                yield from _fastq_records(raw, partition.begin, partition.end)


def _lines(file, at: int, step: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """(offset, line without its end) from an offset on."""
    held = b""
    while data := file.read(step):
        held += data
        *whole, held = held.split(b"\n")
        for line in whole:
            yield at, line.rstrip(b"\r")
            at += len(line) + 1
    if held:
        yield at, held.rstrip(b"\r")


def _fastq_records(file, begin: int, end: int | None) -> Iterator[tuple]:
    """Records whose @ line begins in a range. A header is a line with an @, two lines before
    a +, whose sequence and qualities are of one length."""
    at = max(begin - 1, 0)
    if begin:
        file.seek(at)
    lines = _lines(file, at)
    if begin and next(lines, None) is None:  # the rest of the line that begin cuts
        return
    window: list[tuple[int, bytes]] = []
    sure = not begin
    for offset, line in lines:
        window.append((offset, line))
        if len(window) < 4:
            continue
        (first, head), (_, seq), (_, plus), (_, quals) = window
        if end is not None and first >= end:
            return
        fits = head[:1] == b"@" and plus[:1] == b"+"
        if fits and (sure or len(seq) == len(quals)):
            sure = True
            yield head[1:].split()[0].decode() if head[1:].split() else "", seq.decode(), quals.decode(), len(seq) == len(quals)
            window = []
        else:  # a broken record: the next header is sought
            sure = False
            window.pop(0)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BamSource)
    spark.dataSource.register(FastqSource)


def name_grouped(alignments: dict[str, DataFrame]) -> DataFrame:
    """read_id with a map from aligner to record: the union of the aligners' records grouped
    by name (without a ``pt:i:`` suffix)."""
    parts = None
    for aligner, df in alignments.items():
        one = df.withColumn("aligner", F.lit(aligner)).withColumn("read_id", F.regexp_replace("name", r"[ _]pt:i:.*$", ""))
        parts = one if parts is None else parts.unionByName(one, allowMissingColumns=True)
    columns = [c for c in parts.columns if c not in ("aligner", "read_id")]
    # Of several records of a read the best mapped counts, then the first by place.
    order = F.struct(*[F.col(c) * sign for c, sign in (("mapq", -1), ("start", 1), ("flag", 1)) if c in columns], F.xxhash64(*[c for c in columns if c != "tags"]))
    best = parts.groupBy("read_id", "aligner").agg(F.min_by(F.struct(*columns), order).alias("record"))
    return best.groupBy("read_id").agg(F.map_from_entries(F.collect_list(F.struct("aligner", "record"))).alias("records"))
