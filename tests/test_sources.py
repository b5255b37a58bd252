import gzip
import random

import pytest
from pyspark.sql import functions as F

from strandlake.config import CompressOptions
from strandlake.functions import dna
from strandlake.operators.prefix import numbered, running_total
from strandlake.sources import blast_xml, fasta, psl


def test_fasta_files(spark, tmp_path):
    (tmp_path / "a.fa").write_text("> one \nACGT\nAC*T\n\n>two\nNNAC*\n")
    (tmp_path / "b.fa").write_text(">three x\r\nacgt\r\n>empty\n>last\nA")
    got = [tuple(r) for r in fasta.read_fasta(spark, str(tmp_path / "a.fa"), str(tmp_path / "b.fa")).orderBy("seq_id").collect()]
    assert got == [(0, "one", "ACGTACXT"), (1, "two", "NNAC"), (2, "three x", "acgt"), (3, "empty", ""), (4, "last", "A")]
    back = str(tmp_path / "out")
    seqs = spark.createDataFrame([(7, "x", "ACGT"), (3, "y z", "TT")], "seq_id long, name string, residues string")
    fasta.write_fasta(fasta.numbered_fasta(seqs).coalesce(1), back)
    assert sorted((r["name"], r["seq"]) for r in fasta.read_fasta(spark, back).collect()) == [("1 y z", "TT"), ("2 x", "ACGT")]


def _chunks_of(text, size, first=0):
    """Plain reading: the chunks of every record of a file."""
    out, seq_id = [], first - 1
    for record in ("\n" + text).split("\n>")[1:]:
        header, *lines = record.split("\n")
        seq, seq_id = "".join(x.strip("* \n\r\t") for x in lines).replace("*", "X"), seq_id + 1
        out += [(seq_id, header.strip("> \n\r\t"), i // size, seq[i : i + size]) for i in range(0, max(1, len(seq)), size)]
    return out


@pytest.mark.parametrize("split, size", [(100, 16), (300, 1000), (1 << 20, 7)])
def test_fasta_chunks(spark, tmp_path, split, size):
    rng = random.Random(split + size)
    texts = []
    for _ in range(3):
        text = rng.choice(["", "no record\n", "\n"])
        for k in range(10):
            lines = ["".join(rng.choice("ACGT*") for _ in range(rng.choice([0, 1, 5, 16, 60]))) + rng.choice(["", "\r", " "]) for _ in range(rng.choice([0, 1, 1, 3, 12]))]
            text += "".join(x + "\n" for x in [f"> r{k} {rng.random()}" if k % 9 else ">", *lines])
        texts.append(text)
    (tmp_path / "a.fa").write_text(texts[0])
    (tmp_path / "b.fa").write_text(texts[1].rstrip("\n"))
    (tmp_path / "c.fa.gz").write_bytes(gzip.compress(texts[2].encode()))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in before:
            spark.conf.set(k, split)
        got = [tuple(r) for r in fasta.read_fasta_chunks(spark, *(str(tmp_path / x) for x in ("a.fa", "b.fa", "c.fa.gz")), size=size).select("seq_id", "name", "chunk", "residues").orderBy("seq_id", "chunk").collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == _chunks_of(texts[0], size) + _chunks_of(texts[1].rstrip("\n"), size, 10) + _chunks_of(texts[2], size, 20)


def test_fasta_chunks_agree_with_records(spark, tmp_path):
    (tmp_path / "a.fa").write_text("> one \nACGT\nAC*T\n\n>two\nNNAC*\n")
    (tmp_path / "none.fa").write_text("\n\n")
    paths = [str(tmp_path / x) for x in ("none.fa", "a.fa")]
    want = [tuple(r) for r in fasta.read_fasta(spark, *paths).orderBy("seq_id").collect()]
    assert [(r.seq_id, r.name, r.residues) for r in fasta.read_fasta_chunks(spark, *paths).orderBy("seq_id").collect()] == want
    assert fasta.read_fasta_chunks(spark, paths[0]).count() == 0


def test_psl_files(spark, tmp_path):
    line = "\t".join("59 1 0 0 0 0 1 7 - q 60 0 60 4 200 10 77 2 30,30, 0,30, 10,47,".split())
    (tmp_path / "a.psl").write_text(line + "\n" + line.replace("\t-\t", "\t+\t") + "\n")
    rows = psl.read_psl(spark, str(tmp_path / "a.psl"))
    first = rows.filter("strand = '-'").first()
    assert (first["q_name"], first["t_size"], first["t_starts"]) == ("q", 200, [10, 47])
    assert first["block_sizes"] == [30, 30] and rows.count() == 2
    assert [r[0] for r in rows.filter("strand = '-'").select(psl.psl_line()).collect()] == [line]
    targets = spark.createDataFrame([(4, "chr", 5000, 550)], "exp_id long, name string, seq_length long, offset long")
    lifted = psl.lifted(rows, targets).first()
    assert (lifted["t_name"], lifted["t_size"], lifted["t_start"], lifted["t_end"], lifted["t_starts"]) == ("chr", 5000, 560, 627, [560, 597])
    psl.write_psl(rows, str(tmp_path / "out"))
    assert psl.read_psl(spark, str(tmp_path / "out")).count() == 2


def test_blast_xml_files(spark, tmp_path):
    hsp = "<Hsp><Hsp_num>1</Hsp_num><Hsp_evalue>1e-9</Hsp_evalue><Hsp_query-from>1</Hsp_query-from><Hsp_query-to>81</Hsp_query-to><Hsp_hit-from>90</Hsp_hit-from><Hsp_hit-to>10</Hsp_hit-to><Hsp_hit-frame>-1</Hsp_hit-frame></Hsp>"
    one = f"<Iteration><Iteration_iter-num>1</Iteration_iter-num><Iteration_hits><Hit><Hit_num>1</Hit_num><Hit_accession>17</Hit_accession><Hit_hsps>{hsp}</Hit_hsps></Hit></Iteration_hits></Iteration>"
    none = "<Iteration><Iteration_iter-num>2</Iteration_iter-num><Iteration_hits></Iteration_hits></Iteration>"
    (tmp_path / "r.xml").write_text(f"<BlastOutput><BlastOutput_iterations>{one}{none}</BlastOutput_iterations></BlastOutput>")
    got = blast_xml.read_blast_xml(spark, str(tmp_path / "r.xml")).collect()
    assert [(r["query_no"], r["coarse_id"], r["hit_from"], r["hit_to"]) for r in got] == [(0, 17, 9, 89)]


def test_goldens_of_functions(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first()["x"]
    assert value(dna.revcomp(F.lit("ACGTN"))) == "NACGT"
    assert value(dna.kmer_hash(F.lit("ACGT"), 4)) == 228
    assert value(dna.kmer_hash(F.lit("ACNT"), 4)) == -1
    assert value(dna.octal(F.lit(8))) == "10"
    assert value(F.hex(dna.to_half_bytes(F.lit("s2T")))) == "E2B1"
    assert value(dna.from_half_bytes(dna.to_half_bytes(F.lit("i17-AC")), F.lit(6))) == "i17-AC"
    assert value(dna.be_int(dna.be_bytes(F.lit(123456789).cast("long")))) == 123456789
    assert value(dna.normalised(F.lit("acgu*R"))) == "ACGNNN"


def test_running_totals(spark):
    df = spark.createDataFrame([(1, 5), (4096, 7), (9000, 3), (9001, 1)], "id long, n long")
    assert [r["t"] for r in running_total(df, "id", F.col("n"), "t").orderBy("id").collect()] == [0, 5, 12, 15]
    assert [r["k"] for r in numbered(df, "id", "k").orderBy("id").collect()] == [1, 2, 3, 4]


def test_options_are_checked():
    with pytest.raises(ValueError):
        CompressOptions(map_seed_size=16)
