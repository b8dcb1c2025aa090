"""SAM text and BAM files as alignments: rec_idx, qname, flag, rname, pos, mapq, cigar, mate_rname, mate_pos, sa, nm.

SAM is split by Spark's text source. BAM is a data source of its own ("bam"): the file is cut at BGZF blocks, and each task finds the
first record of its stretch by itself. Filters on flag, the wish for an SA tag and regions can be given as options, before rows are made.
Regions (``chr:start-end`` from 0, half-open, separated by commas) read only the chunks that a .bai index beside the file names for them;
without an index the whole file is read and the same rows come out."""

from __future__ import annotations

import bisect
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "rec_idx long, qname string, flag int, rname string, pos long, mapq int, cigar string, mate_rname string, mate_pos long, sa string, nm long"
ARROW = pa.schema([("rec_idx", pa.int64()), ("qname", pa.string()), ("flag", pa.int32()), ("rname", pa.string()), ("pos", pa.int64()), ("mapq", pa.int32()), ("cigar", pa.string()), ("mate_rname", pa.string()), ("mate_pos", pa.int64()), ("sa", pa.string()), ("nm", pa.int64())])
# Operation letters by code, sizes of tag types.
OPS = "MIDNSHP=X"
SIZES = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
NUMBERS = {"c": "<b", "C": "<B", "s": "<h", "S": "<H", "i": "<i", "I": "<I"}
STRETCH = 32 << 20
#: A record has fewer bytes.
LONGEST = 1 << 28


def sam(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.text(path).where("value NOT LIKE '@%' AND value <> ''").select(F.monotonically_increasing_id().alias("rec_idx"), F.split("value", "\t").alias("f"))
    # header lines may reach these expressions before they are filtered out, so nothing here fails on short or odd lines
    f, tags_ = (lambda i: F.get("f", F.lit(i))), F.col("f")
    tag = lambda t: F.regexp_extract(F.get(F.filter(tags_, lambda x: x.startswith(t)), F.lit(0)), r"^..:.:(.*)$", 1)
    star = lambda c: F.when(c != "*", c)
    return rows.select("rec_idx", f(0).alias("qname"), f(1).try_cast("int").alias("flag"), star(f(2)).alias("rname"), (f(3).try_cast("long") - 1).alias("pos"), f(4).try_cast("int").alias("mapq"), f(5).alias("cigar"), star(F.when(f(6) == "=", f(2)).otherwise(f(6))).alias("mate_rname"), (f(7).try_cast("long") - 1).alias("mate_pos"), F.when(F.exists(tags_, lambda x: x.startswith("SA:Z:")), tag("SA:Z:")).alias("sa"), F.when(F.exists(tags_, lambda x: x.startswith("NM:i:")), tag("NM:i:").try_cast("long")).alias("nm"))


def with_ends(alignments: DataFrame) -> DataFrame:
    """Adds chrom, aln_start, aln_end: the stretch of the reference that a record covers."""
    from ..functions.cigar import op_sum

    return alignments.withColumns({"chrom": F.col("rname"), "aln_start": F.col("pos"), "aln_end": F.col("pos") + F.greatest(op_sum(F.col("cigar"), "MDNX="), F.lit(1))}).where("rname IS NOT NULL")


# --- BAM


def opened(path: str):
    """A random-access file of any store that Arrow knows."""
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path) if re.match(r"\w[\w+.-]*:/", path) else (fs.LocalFileSystem(), path)
    return store.open_input_file(at)


def block_size(head: bytes) -> int | None:
    """Size of the BGZF block that the bytes begin with, or None if they begin none."""
    if len(head) < 18 or head[:4] != b"\x1f\x8b\x08\x04":
        return None
    extra = struct.unpack_from("<H", head, 10)[0]
    at, end = 12, 12 + extra
    while at + 4 <= min(end, len(head)):
        n = struct.unpack_from("<H", head, at + 2)[0]
        if head[at : at + 2] == b"BC" and n == 2:
            return struct.unpack_from("<H", head, at + 4)[0] + 1
        at += 4 + n
    return None


class Blocks:
    """The uncompressed stream of a BGZF file from the block that begins at ``at``."""

    def __init__(self, file, at: int):
        self.file, self.next, self.size = file, at, file.size()
        self.data, self.pos, self.block_at, self.last_size = b"", 0, at, 0

    def more(self) -> bool:
        if self.next >= self.size:
            return False
        head = self.file.read_at(min(1 << 16, self.size - self.next), self.next)
        n = block_size(head)
        if n is None:
            raise ValueError("not a BGZF block")
        if len(head) < n:
            head = self.file.read_at(n, self.next)
        new = zlib.decompress(head[:n], 31)
        self.data, self.last_size = self.data[self.pos :] + new, len(new)
        self.pos, self.block_at, self.next = 0, self.next, self.next + n
        return True

    def need(self, n: int) -> bool:
        while len(self.data) - self.pos < n:
            if not self.more():
                return False
        return True

    def take(self, n: int) -> bytes:
        if not self.need(n):
            raise ValueError("the file ends within a record")
        self.pos += n
        return self.data[self.pos - n : self.pos]


def read_header(blocks: Blocks) -> list[tuple[str, int]]:
    """Names and lengths of the references; the stream then stands at the first record."""
    if blocks.take(4) != b"BAM\x01":
        raise ValueError("not a BAM file")
    blocks.take(struct.unpack("<i", blocks.take(4))[0])
    out = []
    for _ in range(struct.unpack("<i", blocks.take(4))[0]):
        name = blocks.take(struct.unpack("<i", blocks.take(4))[0])[:-1].decode()
        out.append((name, struct.unpack("<i", blocks.take(4))[0]))
    return out


def tags(raw: bytes) -> tuple[str | None, int | None]:
    """(SA, NM) of a record's tags."""
    sa = nm = None
    at = 0
    while at + 3 <= len(raw):
        name, kind = raw[at : at + 2], chr(raw[at + 2])
        at += 3
        if kind in "ZH":
            end = raw.index(0, at)
            if name == b"SA":
                sa = raw[at:end].decode()
            at = end + 1
        elif kind == "B":
            n = struct.unpack_from("<i", raw, at + 1)[0]
            at += 5 + n * SIZES[chr(raw[at])]
        else:
            if name == b"NM" and kind in NUMBERS:
                nm = struct.unpack_from(NUMBERS[kind], raw, at)[0]
            at += SIZES[kind]
    return sa, nm


def parse(raw: bytes, refs: list[tuple[str, int]]) -> tuple:
    """qname, flag, rname, pos, mapq, cigar, mate_rname, mate_pos, sa, nm of a record without its size."""
    ref, pos, n_name, mapq, _, n_cigar, flag, n_seq, mate, mate_pos, _ = struct.unpack_from("<iiBBHHHiiii", raw)
    at = 32 + n_name
    name = raw[32 : at - 1].decode()
    ops = struct.unpack_from(f"<{n_cigar}I", raw, at)
    cigar = "".join(f"{x >> 4}{OPS[x & 15]}" for x in ops) or "*"
    at += 4 * n_cigar + (n_seq + 1) // 2 + n_seq
    return (name, flag, refs[ref][0] if ref >= 0 else None, pos, mapq, cigar, refs[mate][0] if mate >= 0 else None, mate_pos, *tags(raw[at:]))


def plausible(data: bytes, at: int, refs: int) -> int | None:
    """Where the next record begins if one begins at ``at``, or None."""
    if at + 36 > len(data):
        return None
    n, ref, pos, n_name, _, _, n_cigar, _, n_seq, mate, mate_pos, _ = struct.unpack_from("<iiiBBHHHiiii", data, at)
    rest = 32 + n_name + 4 * n_cigar + (n_seq + 1) // 2 + n_seq
    fine = -1 <= ref < refs and -1 <= mate < refs and pos >= -1 and mate_pos >= -1 and n_name > 1 and n_seq >= 0 and rest <= n < LONGEST
    if not fine or at + 36 + n_name > len(data) or data[at + 35 + n_name] != 0 or not data[at + 36 : at + 35 + n_name].isascii():
        return None
    return at + 4 + n


def regions_of(text: str, refs: list[tuple[str, int]]) -> list[tuple[int, int, int]]:
    """(reference, start, end) of ``chr:start-end`` entries; an entry without positions is the whole reference. Names may hold colons."""
    number, out = {name: i for i, (name, _) in enumerate(refs)}, []
    for entry in filter(None, text.split(",")):
        name, _, span = entry.rpartition(":")
        if entry in number:
            name, span = entry, f"0-{refs[number[entry]][1]}"
        start, _, end = span.partition("-")
        if name not in number or not start.isdigit() or not end.isdigit() or int(start) >= int(end):
            raise ValueError(f"not a region of this file: {entry}")
        out.append((number[name], int(start), int(end)))
    return out


def region_bins(start: int, end: int) -> list[range]:
    """The index's bins that may hold records overlapping [start, end), a range for each of its six levels."""
    return [range(first + (start >> shift), first + ((end - 1) >> shift) + 1) for shift in range(14, 30, 3) for first in [((1 << (29 - shift)) - 1) // 7]]


def read_index(raw: bytes) -> list[tuple[dict[int, list[tuple[int, int]]], list[int]]]:
    """(chunks by bin, least offset of each 16,384 positions) of every reference in a .bai index."""
    if raw[:4] != b"BAI\x01":
        raise ValueError("not a BAI index")
    at, out = 8, []
    for _ in range(struct.unpack_from("<i", raw, 4)[0]):
        bins: dict[int, list[tuple[int, int]]] = {}
        n_bins = struct.unpack_from("<i", raw, at)[0]
        at += 4
        for _ in range(n_bins):
            bin_, n = struct.unpack_from("<Ii", raw, at)
            bins[bin_] = list(struct.iter_unpack("<QQ", raw[at + 8 : at + 8 + 16 * n]))
            at += 8 + 16 * n
        n = struct.unpack_from("<i", raw, at)[0]
        out.append((bins, list(struct.unpack_from(f"<{n}Q", raw, at + 4))))
        at += 4 + 8 * n
    return out


def region_chunks(index: list, regions: list[tuple[int, int, int]], stretch: int) -> list[tuple[int, int]]:
    """Disjoint ranges of virtual offsets that hold all records overlapping the regions, longer ones cut where the index knows a record.

    A region's records lie behind the least offset of its first 16,384 positions and, as the file is sorted, before any record of a bin that
    begins at the region's end or later."""
    levels = [(((1 << (29 - shift)) - 1) // 7, shift) for shift in range(29, 13, -3)]
    later: dict[int, tuple[list[int], list[int]]] = {}
    found = []
    for ref, start, end in regions:
        bins, least = index[ref] if ref < len(index) else ({}, [])
        if ref not in later:
            begins = sorted(((k - first << shift, min(bins[k])[0]) for k in bins if bins[k] for first, shift in levels if first <= k < first + (1 << 29 - shift)), reverse=True)
            later[ref] = [x for x, _ in begins][::-1], list(accumulate((x for _, x in begins), min))[::-1]
        at, offsets = later[ref]
        k = bisect.bisect_left(at, end)
        low = least[min(start >> 14, len(least) - 1)] if least else 0
        high = offsets[k] if k < len(at) else 1 << 64
        found += [(max(a, low), min(b, high)) for level in region_bins(start, end) for k in level if k in bins for a, b in bins[k] if b > low and a < high]
    whole: list[list[int]] = []
    for a, b in sorted(found):
        if whole and a <= whole[-1][1]:
            whole[-1][1] = max(whole[-1][1], b)
        else:
            whole.append([a, b])
    known = sorted({x for ref in {r for r, _, _ in regions} if ref < len(index) for x in index[ref][1]})
    out = []
    for a, b in whole:
        for x in known:
            if a < x < b and (x >> 16) - (a >> 16) >= stretch:
                out.append((a, x))
                a = x
        out.append((a, b))
    return out


class BamReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.stretch = options["path"], int(options.get("stretch", STRETCH))
        self.skip, self.require_sa = int(options.get("skip_flags", 0)), str(options.get("require_sa", "false")).lower() == "true"
        self.regions = options.get("regions")

    def partitions(self):
        file = opened(self.path)
        if self.regions is not None:
            wanted = regions_of(self.regions, read_header(Blocks(file, 0)))
            try:
                index = opened(f"{self.path}.bai")
            except FileNotFoundError:
                pass
            else:
                # one stretch at least, or Spark reads without any
                return [InputPartition((a, b, True)) for a, b in region_chunks(read_index(index.read()), wanted, self.stretch) or [(0, 0)]]
        size = file.size()
        return [InputPartition((a, min(a + self.stretch, size), False)) for a in range(0, max(size, 1), self.stretch)]

    def overlaps(self, got: tuple, by_name: dict[str, list[tuple[int, int]]]) -> bool:
        covered = max(1, sum(int(n) for n in re.findall(r"(\d+)[MDN=X]", got[5])))
        return any(got[3] < end and got[3] + covered > start for start, end in by_name.get(got[2], ()))

    def first_record(self, file, start: int, refs: int) -> Blocks | None:
        """The stream at the first record that begins in a block beginning at or after ``start``: block starts are found by their marks,
        the record by three records in a row that make sense."""
        size, at = file.size(), start
        while at < size:
            window = file.read_at(min(1 << 17, size - at), at)
            k = window.find(b"\x1f\x8b\x08\x04")
            while k >= 0:
                n = block_size(window[k : k + 64])
                if n and (at + k + n == size or block_size(file.read_at(min(64, size - at - k - n), at + k + n))):
                    return self.in_block(file, at + k, refs)
                k = window.find(b"\x1f\x8b\x08\x04", k + 1)
            at += max(1, len(window) - 3)
        return None

    def in_block(self, file, at: int, refs: int) -> Blocks | None:
        """Unpacks until three records are found, however long they are, or the file ends; None if no record begins in the rest of the file."""
        blocks, data = Blocks(file, at), bytearray()

        def has(n: int) -> bool:
            while len(data) < n and blocks.more():
                data.extend(blocks.data)
                blocks.pos = len(blocks.data)
            return len(data) >= n

        k = 0
        while has(k + 1):
            here, good = k, 0
            # 300 bytes hold a record's fixed part and its name
            while good < 3 and (has(here + 300) or here < len(data)) and (after := plausible(data, here, refs)):
                here, good = after, good + 1
            if good == 3 or good and here == len(data):
                blocks = Blocks(file, at)
                blocks.need(k)
                blocks.take(k)
                return blocks
            k += 1
            if k == LONGEST:
                raise ValueError(f"no record begins in {LONGEST} bytes from the block at {at}")
        return None

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        start, end, virtual = partition.value
        file = opened(self.path)
        blocks = Blocks(file, 0)
        refs = read_header(blocks)
        by_name: dict[str, list[tuple[int, int]]] = {}
        for ref, a, b in regions_of(self.regions or "", refs):
            by_name.setdefault(refs[ref][0], []).append((a, b))
        if virtual:
            blocks = Blocks(file, start >> 16)
            blocks.need(start & 0xFFFF)
            blocks.take(start & 0xFFFF)
        elif start:
            blocks = self.first_record(file, start, len(refs))
            if blocks is None:
                return
        rows, n = [], 0
        while True:
            # a record belongs to the stretch in which the block of its first byte begins
            if not blocks.need(1):
                break
            # what is left after a record is of the last block read
            if virtual and (blocks.block_at << 16) + blocks.last_size - (len(blocks.data) - blocks.pos) >= end:
                break
            if not virtual and blocks.block_at >= end and self.begins_in(blocks, end):
                break
            raw = blocks.take(struct.unpack("<i", blocks.take(4))[0])
            flag = struct.unpack_from("<H", raw, 14)[0]
            n += 1
            if flag & self.skip:
                continue
            got = parse(raw, refs)
            if self.require_sa and got[8] is None or self.regions is not None and not self.overlaps(got, by_name):
                continue
            rows.append((start + n, *got))
            if len(rows) == 8192:
                yield self.batch(rows)
                rows = []
        if rows:
            yield self.batch(rows)

    def begins_in(self, blocks: Blocks, end: int) -> bool:
        """Whether the next byte is of the last block read, so that the record begins at or after ``end``."""
        return len(blocks.data) - blocks.pos <= blocks.last_size

    def batch(self, rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)


class BamSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BamReader:
        return BamReader(self.options)


def bam(spark: SparkSession, path: str, **options) -> DataFrame:
    spark.dataSource.register(BamSource)
    return spark.read.format("bam").options(**{k: str(v) for k, v in options.items()}).load(path)


def bam_contigs(path: str) -> dict[str, int]:
    return dict(read_header(Blocks(opened(path), 0)))
