"""Readers on small files written here."""

import gzip
import random
import struct
import zlib

import pytest

from svloom.plans import programs
from svloom.sources import alignments, bed, bedpe, fasta, gtf, lists, vcf


def put(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


def test_lists(spark, tmp_path):
    assert lists.contig_lengths(spark, put(tmp_path, "a", "c1\t5\nc2\t7\n")).count() == 2
    for bad in ("c1\n", "c1\t-5\n", "c1\t5\nc1\t5\n"):
        with pytest.raises(Exception):  # noqa: B017
            lists.contig_lengths(spark, put(tmp_path, "b", bad)).collect()
    with pytest.raises(Exception):  # noqa: B017
        lists.names(spark, put(tmp_path, "c", "a b\n")).collect()
    assert lists.paths(spark, put(tmp_path, "d", "f1\nf2\n"), True) == ["f1", "f2"] and lists.paths(spark, "x", False) == ["x"]


VCF = """##fileformat=VCFv4.2
##contig=<ID=2,length=500000>
##contig=<ID=13,length=500000>
#CHROM	POS	ID	REF	ALT	QUAL	FILTER	INFO
2	321692	bnd2.1	T	]13:123466]T	.	PASS	SVTYPE=BND;MATEID=bnd2.2;CIPOS=-110,73
13	123466	bnd2.2	C	C[2:321692[	.	PASS	SVTYPE=BND;MATEID=bnd2.1
13	200	del1	C	<DEL>	.	.	SVTYPE=DEL
"""


def test_vcf_programs(spark, tmp_path):
    path, contigs = put(tmp_path, "s.vcf", VCF), put(tmp_path, "contigs", "2\t500000\n13\t500000\n")
    rows = vcf.records(spark, path)
    got = {r["id"]: r for r in rows.select("id", "pos", "sample", vcf.cipos(rows["info"]).alias("c")).collect()}
    assert got["bnd2.1"]["c"] == [110, 73] and got["bnd2.2"]["c"] is None and got["del1"]["pos"] == 199 and got["del1"]["sample"] == "s"
    out = programs.cluster_calls(spark, path, contigs, 8).collect()
    assert sorted((r["type"], r["score"]) for r in out) == [("BND_PAIR", 1), ("DEL", 1)]
    regions = put(tmp_path, "r.bedpe", "2\t321000\t322000\t13\t123000\t124000\tx\t8\t.\t.\tBND_PAIR\n")
    assert [r["id"] for r in programs.subset_calls(spark, path, regions).collect()] == ["bnd2.1", "bnd2.2"]
    assert programs.subset_calls(spark, path, regions, inverse=True).count() == 0
    assert bedpe.regions(spark, regions).count() == 1
    assert [r["id"] for r in programs.chromosome_calls(spark, path, put(tmp_path, "chr", "13\n")).collect()] == ["del1"]
    with pytest.raises(Exception):  # noqa: B017
        vcf.variants(rows, lists.contig_lengths(spark, put(tmp_path, "short", "2\t100\n13\t500000\n")))["pairs"].collect()
    assert [r["line"].split("\t")[4] for r in programs.corrected_calls(spark, path).collect()][:2] == ["]13:123466]T", "C[2:321692["]


def test_gtf_fasta_bed(spark, tmp_path):
    rows = gtf.features(spark, put(tmp_path, "g", 'c\ts\ttranscript\t11\t20\t.\t+\t.\tgene_id "i"; gene_name "n";\nc\ts\texon\t1\t2\t.\t+\t.\tgene_id "i"\n')).collect()
    assert [(r["f_start"], r["f_end"], r["name"]) for r in rows] == [(10, 20, "n")]
    ref = fasta.reference(spark, put(tmp_path, "f.fa", ">c1 x\nACGT\nAC\n>c2\nGG\n"), 4).collect()
    assert {(r["contig"], r["offset"], r["seq"]) for r in ref} == {("c1", 0, "ACGT"), ("c1", 4, "AC"), ("c2", 0, "GG")}
    lines = bed.lines(spark, put(tmp_path, "b", "r\t0\t5\thuman\t+\tc@1-2\nr\t5\t9\tmuERV\t+\t.\n")).collect()
    assert sorted(r["rec_idx"] for r in lines) == [0, 1]


def block(data):
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    return struct.pack("<4BIBBHBBHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def record(i):
    name = f"read{i}".encode() + b"\0"
    cigar = struct.pack("<II", 40 << 4 | 4, 60 << 4 | 0)
    tags = b"NMC" + bytes([i % 5]) + (b"SAZchr2,11,+,40M60S,60,1;\0" if i % 3 == 0 else b"")
    body = struct.pack("<iiBBHHHiiii", 0, i * 10, len(name), 60, 0, 2, 0, 100, -1, -1, 0) + name + cigar + bytes(50) + bytes(100) + tags
    return struct.pack("<i", len(body)) + body


def test_bam(spark, tmp_path):
    head = b"BAM\x01" + struct.pack("<i", 0) + struct.pack("<i", 2) + b"".join(struct.pack("<i", len(n) + 1) + n + b"\0" + struct.pack("<i", 1000) for n in (b"chr1", b"chr2"))
    data = head + b"".join(record(i) for i in range(3000))
    raw = b"".join(block(data[a : a + 7000]) for a in range(0, len(data), 7000)) + block(b"")
    path = tmp_path / "x.bam"
    path.write_bytes(raw)
    assert gzip.decompress(raw) == data
    for stretch in (1 << 30, 9000):
        rows = alignments.bam(spark, str(path), stretch=stretch).collect()
        assert sorted(int(r["qname"][4:]) for r in rows) == list(range(3000))
    some = {r["qname"]: r for r in rows}
    assert (some["read3"]["cigar"], some["read3"]["nm"], some["read3"]["sa"], some["read3"]["pos"], some["read4"]["sa"]) == ("40S60M", 3, "chr2,11,+,40M60S,60,1;", 30, None)
    assert alignments.bam(spark, str(path), require_sa=True).count() == 1000
    assert alignments.bam_contigs(str(path)) == {"chr1": 1000, "chr2": 1000}


def test_bam_long_records(spark, tmp_path):
    """Records of over 200 KB, cut anywhere: no stretch may lose those that begin in it."""
    rng, bases = random.Random(1), 150_000
    data = b"BAM\x01" + struct.pack("<i", 0) + struct.pack("<i", 1) + struct.pack("<i", 5) + b"chr1\0" + struct.pack("<i", 1 << 20)
    for i in range(12):
        name = f"long{i}".encode() + b"\0"
        body = struct.pack("<iiBBHHHiiii", 0, i, len(name), 60, 0, 1, 0, bases, -1, -1, 0) + name + struct.pack("<I", bases << 4) + rng.randbytes(bases // 2) + rng.randbytes(bases)
        data += struct.pack("<i", len(body)) + body
    path = tmp_path / "long.bam"
    path.write_bytes(b"".join(block(data[a : a + 60000]) for a in range(0, len(data), 60000)) + block(b""))
    for stretch in (1 << 30, 500_000, 100_000):
        rows = alignments.bam(spark, str(path), stretch=stretch).collect()
        assert sorted(int(r["qname"][4:]) for r in rows) == list(range(12))


def header_of(names):
    return b"BAM\x01" + struct.pack("<i", 0) + struct.pack("<i", len(names)) + b"".join(struct.pack("<i", len(n) + 1) + n + b"\0" + struct.pack("<i", 1 << 28) for n in names)


def bin_of(start, end):
    for first, shift in ((4681, 14), (585, 17), (73, 20), (9, 23), (1, 26)):
        if start >> shift == (end - 1) >> shift:
            return first + (start >> shift)
    return 0


def test_bam_regions(spark, tmp_path):
    """Indexed reads give the rows of a whole read, whatever the cut; each record once, though regions overlap."""
    rng, size = random.Random(5), 3000
    places = sorted((rng.randrange(2), rng.randrange(3_000_000), rng.choice((1, 60, 20_000, 400_000))) for _ in range(1500))
    data, starts = header_of([b"chr1", b"HLA:01"]), []
    for i, (ref, pos, n) in enumerate(places):
        name = f"read{i}".encode() + b"\0"
        body = struct.pack("<iiBBHHHiiii", ref, pos, len(name), 60, 0, 1, 0, 0, -1, -1, 0) + name + struct.pack("<I", n << 4 | 3)
        starts.append(len(data))
        data += struct.pack("<i", len(body)) + body
    blocks = [block(data[a : a + size]) for a in range(0, len(data), size)]
    at = [sum(map(len, blocks[:k])) for k in range(len(blocks) + 1)]
    virtual = lambda x: at[x // size] << 16 | x % size
    bins, least = ({}, {}), ({}, {})
    for (ref, pos, n), a, b in zip(places, starts, [*starts[1:], len(data)], strict=True):
        bins[ref].setdefault(bin_of(pos, pos + n), []).append((virtual(a), virtual(b)))
        for w in range(pos >> 14, (pos + n - 1 >> 14) + 1):
            least[ref].setdefault(w, virtual(a))
    index = b"BAI\x01" + struct.pack("<i", 2)
    for ref in (0, 1):
        index += struct.pack("<i", len(bins[ref])) + b"".join(struct.pack("<Ii", k, len(c)) + b"".join(struct.pack("<QQ", *x) for x in c) for k, c in bins[ref].items())
        last = max(least[ref]) + 1
        index += struct.pack("<i", last) + b"".join(struct.pack("<Q", least[ref].get(w, 0)) for w in range(last))
    path = tmp_path / "r.bam"
    path.write_bytes(b"".join(blocks) + block(b""))
    cases = ("chr1:1000000-1000001", "chr1:0-20000,chr1:10000-500000,HLA:01:2000000-2100000", "HLA:01", "chr1:200000000-200000001")
    wanted = [
        [i for i, (ref, pos, n) in enumerate(places) if any(ref == r and pos < e and pos + n > s for r, s, e in spans)]
        for spans in ([(0, 1_000_000, 1_000_001)], [(0, 0, 20_000), (0, 10_000, 500_000), (1, 2_000_000, 2_100_000)], [(1, 0, 1 << 28)], [])
    ]
    assert len(wanted[0]) > 3 and not wanted[3]
    for indexed in (False, True):
        if indexed:
            (tmp_path / "r.bam.bai").write_bytes(index)
        for stretch in (1 << 30, 5000):
            for text, ids in zip(cases, wanted, strict=True):
                rows = alignments.bam(spark, str(path), stretch=stretch, regions=text).collect()
                assert sorted(int(r["qname"][4:]) for r in rows) == ids
                assert len({r["rec_idx"] for r in rows}) == len(rows)
    few, whole = (sum(b - a for a, b in alignments.region_chunks(alignments.read_index(index), [(0, s, e)], 1 << 30)) for s, e in ((0, 20_000), (0, 1 << 28)))
    assert few * 5 < whole  # what the index leaves out is not read
    for bad in ("chr9:0-5", "chr1:5-5", "chr1:x-5"):
        with pytest.raises(Exception, match="not a region"):
            alignments.bam(spark, str(path), regions=bad).collect()


def test_fasta_index(spark, tmp_path):
    """The same pieces with an index as without one; with wanted spans those that overlap them."""
    rng = random.Random(2)
    seqs = {"c1": "".join(rng.choices("ACGTacgtN", k=1003)), "c2": "A", "c3": "".join(rng.choices("ACGT", k=840))}
    text, index = "", ""
    for name, seq in seqs.items():
        text += f">{name} more\n"
        index += f"{name}\t{len(seq)}\t{len(text)}\t60\t61\n"
        text += "".join(seq[a : a + 60] + "\n" for a in range(0, len(seq), 60))
    path = put(tmp_path, "x.fa", text)
    rows = lambda **more: sorted(map(tuple, fasta.reference(spark, path, 100, **more).collect()))
    plain = rows()
    assert "".join(r[3] for r in plain if r[0] == "c1") == seqs["c1"]
    lengths = sorted(map(tuple, fasta.contig_lengths(spark, path).collect()))
    put(tmp_path, "x.fa.fai", index)
    assert rows() == plain
    assert sorted(map(tuple, fasta.contig_lengths(spark, path).collect())) == lengths
    wanted = spark.createDataFrame([("c1", 150, 201), ("c1", 199, 200), ("c3", -40, 1), ("c3", 790, 5000), ("c9", 0, 9), (None, 0, 9)], "contig string, s long, e long")
    assert [r[:2] for r in rows(wanted=wanted)] == [("c1", 100), ("c1", 200), ("c3", 0), ("c3", 700), ("c3", 800)]
    assert set(rows(wanted=wanted)) <= set(plain)


def test_mates_and_counters(spark, tmp_path, capfd):
    """Junctions want every record to name its mate, in any order of the file; the counts are those of the records."""
    from svloom.cli import run

    fa = put(tmp_path, "g.fa", ">2\n" + "ACGGT" * 10 + "\n>13\n" + "TTGCA" * 10 + "\n")
    lines = ["2\t5\tz.1\tT\t]13:7]T\t.\tPASS\tSVTYPE=BND;MATEID=a.2", "2\t9\tq.1\tT\tT[13:8[\t.\tPASS\tSVTYPE=BND;MATEID=q.2", "13\t7\ta.2\tC\tC[2:5[\t.\tPASS\tSVTYPE=BND;MATEID=z.1", "13\t8\tq.2\tC\t]2:9]C\t.\tPASS\tSVTYPE=BND;MATEID=q.1"]
    head = "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\n"
    good = put(tmp_path, "good.vcf", head + "\n".join(lines) + "\n")
    got = sorted(tuple(r)[:2] for r in programs.junctions(spark, good, fa, 4).collect())
    assert got == [("q.1", "q.2"), ("z.1", "a.2")]  # the first in the file is the first of its pair
    bad = {"no mate": lines[:3], "no id": [*lines, lines[0].replace("z.1", ".")], "other mate": [*lines[:3], lines[3].replace("MATEID=q.1", "MATEID=z.1")], "no MATEID": [*lines, "2\t5\td\tT\t<DEL>\t.\t.\tSVTYPE=DEL"], "twice": [*lines, lines[0]]}
    for name, rows in bad.items():
        with pytest.raises(Exception, match="record without id or mate|not mates of each other"):
            programs.junctions(spark, put(tmp_path, f"{name}.vcf", head + "\n".join(rows) + "\n"), fa, 4).collect()
    contigs = put(tmp_path, "contigs", "2\t50\n13\t50\n")
    mixed = put(tmp_path, "mixed.vcf", head + "\n".join([*lines, "2\t5\td\tT\t<DUP>\t.\t.\tSVTYPE=DUP", "2\t5\te\tT\t<X>\t.\t.\tX=1"]) + "\n")
    capfd.readouterr()
    run(spark, ["cluster", "-v", mixed, "-c", contigs, "-o", str(tmp_path / "clusters")])
    assert "2 records are no paired breakend" in capfd.readouterr().err
    run(spark, ["chromosomes", "-a", mixed, "-c", put(tmp_path, "chr", "2\n"), "-o", str(tmp_path / "kept")])
    assert "2 records kept, 4 removed" in capfd.readouterr().err


def test_sam_paired(spark, tmp_path):
    lines = ["@SQ\tSN:A:0-530\tLN:530", "read\t17\tA:0-530\t475\t60\t56M94H\t*\t0\t0\t*\t*\tNM:i:0\tSA:Z:A:531,5,-,60S90M,60,0;", "read\t17\tA:531\t5\t60\t60S90M\t*\t0\t0\t*\t*\tNM:i:0\tSA:Z:A:0-530,475,-,56M94S,60,0;"]
    calls = programs.paired_calls(spark, put(tmp_path, "p.sam", "\n".join(lines) + "\n"), similarity=0.95)
    row = calls.collect()
    assert len(row) == 1 and row[0]["support_sr"] == 1 and {row[0]["a_chrom"], row[0]["b_chrom"]} == {"A:0-530", "A:531"}


def test_command_line(spark, tmp_path):
    from svloom.cli import run

    path, contigs = put(tmp_path, "s.vcf", VCF), put(tmp_path, "contigs", "2\t500000\n13\t500000\n")
    run(spark, ["cluster", "-v", path, "-c", contigs, "-o", str(tmp_path / "out")])
    lines = sorted(r["value"] for r in spark.read.text(str(tmp_path / "out")).collect())
    assert lines == ["13\t123465\t123466\t2\t321691\t321692\ts:bnd2.2;\t1\t+\t-\tBND_PAIR", "13\t199\t200\t.\t-1\t-1\ts:del1;\t1\t.\t.\tDEL"]
    run(spark, ["correct", "-i", path, "-o", str(tmp_path / "fixed")])
    assert spark.read.text(str(tmp_path / "fixed")).where("value LIKE '##command%'").count() == 1
