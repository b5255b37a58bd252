import random

import pytest
from pyspark.sql import functions as F

from strandlake.config import BlatOptions, CompressOptions, SearchOptions
from strandlake.functions.edits import reverse_complement
from strandlake.operators import compress, intervals, search
from strandlake.plans.database import Database
from strandlake.scratch import scratch
from strandlake.sources.psl import parse_psl
from strandlake.streaming.incremental import compress_stream
from tests.test_align import bases, changed

SMALL = CompressOptions(max_chunk_size=1000, overlap=100)


def collection():
    """Lengths around every limit, a family of changed copies on both strands, and degenerate sequences."""
    r = random.Random(17)
    k, chunk = SMALL.map_seed_size, SMALL.max_chunk_size
    found = [bases(r, n) for n in (1, k - 1, k, k + 1, 300, 301, chunk - 1, chunk, chunk + 1, chunk + k, chunk + k + 2, 2 * chunk)]
    base = bases(r, 2500)
    found += [base, changed(r, base), reverse_complement(changed(r, base)), base, "N" * 400, "A" * 700, "ACGT" * 200, bases(r, 50) + base[:900]]
    return found


@pytest.fixture(scope="module")
def seqs(spark):
    return spark.createDataFrame([(i, s) for i, s in enumerate(collection())], "seq_id long, residues string")


def test_seeds_of_one_chunk_are_not_joined(spark, seqs, monkeypatch):
    """Only seeds that several chunks hold are looked up, on either side."""
    lone, plain = [], compress.shared_marks

    def spy(left, right, *keys):
        lone.append(left.groupBy("h").agg(F.countDistinct("chunk_id").alias("n")).filter("n < 2").count())
        return plain(left, right, *keys)

    monkeypatch.setattr(compress, "shared_marks", spy)
    compress.batch(seqs, SMALL, scratch(spark))
    assert lone[0] == 0


@pytest.mark.parametrize("mode", ["batch", "serial"])
def test_lossless(spark, seqs, mode):
    links, coarse = getattr(compress, mode)(seqs, SMALL, scratch(spark))
    got = {r["seq_id"]: r["residues"] for r in compress.decompress(links, coarse).collect()}
    assert got == dict(enumerate(collection()))
    total = seqs.agg(F.sum(F.length("residues"))).first()[0]
    assert coarse.agg(F.sum("length")).first()[0] < 0.8 * total  # the family shares its coarse pieces
    assert coarse.count() == coarse.select("coarse_id").distinct().count()


def test_batch_does_not_depend_on_order(spark, seqs):
    one, two = (compress.batch(s, SMALL, scratch(spark))[0] for s in (seqs, seqs.orderBy(F.desc("seq_id")).repartition(3)))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))


def test_empty_input(spark, seqs):
    links, coarse = compress.batch(seqs.limit(0), SMALL, scratch(spark))
    assert links.count() == coarse.count() == 0


def test_database(spark, seqs, tmp_path):
    path = str(tmp_path / "db")
    db = Database.create(path, seqs, SMALL)
    with pytest.raises(Exception, match="(?i)exist"):
        Database.create(path, seqs, SMALL)
    db = Database.open(spark, path)
    texts = collection()
    assert db.dbsize == sum(map(len, texts))
    assert {r["seq_id"]: r["residues"] for r in db.decompress().collect()} == dict(enumerate(texts))
    assert [r["residues"] for r in db.sequence(13).collect()] == [texts[13]]
    index = sorted(map(tuple, db.coarse_index().select("coarse_id", "base_start", "length").collect()))
    at = 0
    for _, base, length in index:
        assert base == at
        at += length

    probe = texts[12][200:800]
    queries = spark.createDataFrame([(5, probe), (6, reverse_complement(probe)), (7, bases(random.Random(99), 400))], "query_no long, residues string")
    hits = db.search(queries, SearchOptions())
    found = {(r["query_no"], r["seq_id"]) for r in hits.collect()}
    assert {(q, s) for q in (5, 6) for s in (12, 13, 14, 15)} <= found
    assert 7 not in {q for q, _ in found}
    exact = hits.filter("query_no = 5 and seq_id = 12").orderBy(F.desc("score")).first()
    assert (exact["hit_from"], exact["hit_to"], exact["fwd"]) == (200, 799, True)
    assert db.search(queries, SearchOptions(pooled=True)).count() >= hits.count()
    assert db.search(queries, BlatOptions(min_identity=90.0)).filter("identity < 90").count() == 0

    assert db.search(queries, SearchOptions(load_coarse=True, load_compressed=True)).count() == hits.count()
    spark.catalog.clearCache()

    line = "\t".join(f"59 1 0 0 0 0 1 7 + 5 60 0 60 {0} 200 10 77 2 30,30, 0,30, 10,47,".split())
    psl_rows = parse_psl(spark.createDataFrame([(line,)], "value string"))
    assert [tuple(r) for r in db.hits_of_psl(psl_rows, BlatOptions()).collect()] == [(5, 0, 10, 76)]
    assert [r["hit_to"] for r in db.hits_of_psl(psl_rows, BlatOptions(half_open_hits=True)).collect()] == [77]
    assert db.hits_of_psl(psl_rows, BlatOptions(max_target_span=60)).count() == 0
    some = spark.createDataFrame([(0, 13, 40, "ACGT")], "exp_id long, seq_id long, exp_start long, residues string")
    headers = {o: db.fine_records(some, BlatOptions(**o and dict.fromkeys(o.split(), True))).first()["value"] for o in ("number_targets show_offsets", "show_offsets", "complete_psl")}
    assert headers == {"number_targets show_offsets": "> 0 13 (offset 40)\nACGT", "show_offsets": "> 13 (offset 40)\nACGT", "complete_psl": "> 0 13\nACGT"}
    assert tuple(db.complete(psl_rows, some).select("t_name", "t_size", "t_start", "t_starts").first()) == ("13", len(texts[13]), 50, [50, 87])

    expansions = db.expansions(db.coarse_hits(queries, SearchOptions()), SearchOptions()).collect()
    assert expansions and all("?" not in r["residues"] and r["residues"] == texts[r["seq_id"]][r["exp_start"] : r["exp_end"] + 1] for r in expansions)


def test_append_and_stream(spark, seqs, tmp_path):
    seqs.filter("seq_id < 14").coalesce(1).write.parquet(str(tmp_path / "in"))
    schema = "seq_id long, residues string"
    run = lambda: compress_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "db"), str(tmp_path / "checkpoint"), SMALL).awaitTermination()
    run()
    seqs.filter("seq_id >= 12").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))  # 12 and 13 again
    run()
    db = Database.open(spark, str(tmp_path / "db"))
    assert {r["seq_id"]: r["residues"] for r in db.decompress().collect()} == dict(enumerate(collection()))


def test_overlap_join_equals_brute_force(spark):
    r = random.Random(23)
    left = [(k, a, a + r.randrange(400)) for k in range(3) for a in (r.randrange(2000) for _ in range(30))]
    right = [(k, a, a + r.randrange(50)) for k in range(3) for a in (r.randrange(2000) for _ in range(30))]
    a = spark.createDataFrame(left, "k int, ls long, le long")
    b = spark.createDataFrame(right, "k int, rs long, re long")
    got = sorted(map(tuple, intervals.overlap_join(a, b, ("ls", "le"), ("rs", "re"), 100, ("k",)).select("k", "ls", "le", "rs", "re").collect()))
    assert got == sorted((*x, *y[1:]) for x in left for y in right if x[0] == y[0] and x[1] <= y[2] and y[1] <= x[2])
    plan = intervals.overlap_join(a, b, ("ls", "le"), ("rs", "re"), 100, ("k",))._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_expansion_bounds_goldens(spark):
    rows = [(100, 199, 0, 999, 500, 1499, fwd, 5000) for fwd in (True, False)]
    df = spark.createDataFrame(rows, "hit_from int, hit_to int, coarse_start int, coarse_end int, original_start int, original_end int, fwd boolean, seq_length int")
    start, end = intervals.expansion_bounds(50)
    assert [tuple(r) for r in df.select(start, end).collect()] == [(550, 749), (1250, 1449)]


def test_lambda_solves_its_equation():
    import math

    rate = search.karlin_lambda()
    assert abs(0.25 * math.exp(rate) + 0.75 * math.exp(-3 * rate) - 1) < 1e-9


def test_a_passage_is_found_in_every_target_that_holds_it(spark):
    r = random.Random(23)
    passage, other = bases(r, 80), bases(r, 80)
    targets = spark.createDataFrame([(i, bases(r, 30) + passage + bases(r, 30)) for i in range(520)] + [(520, other)], "target long, residues string")
    queries = spark.createDataFrame([(0, passage), (1, other), (2, passage)], "query_no long, residues string")
    hits = search.local_hits(queries, targets, SearchOptions(), 1e-5, 10**5)
    assert {(h["query_no"], h["target"]) for h in hits.collect()} == {(q, i) for q in (0, 2) for i in range(520)} | {(1, 520)}
    same = spark.createDataFrame([(0, i) for i in range(500)] + [(2, 515), (1, 3), (1, 520)], "query_no long, target long")
    fine = search.local_hits(queries, targets, SearchOptions(), 1e-5, 10**5, same)
    assert {(h["query_no"], h["target"]) for h in fine.collect()} == {(0, i) for i in range(500)} | {(2, 515), (1, 520)}
