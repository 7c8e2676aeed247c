"""Session tables, clock-driven requests, joined streams and saves in batches, against row-by-row forms."""

import base64
import json
import random
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quirewise import sources, streaming
from quirewise.operators import presence, ranking, revisions, saves
from quirewise.session import configure
from quirewise.sources.cadence import CadenceReader, CadenceSource
from quirewise.streaming.save_log import SaveLog, saver
from quirewise.streaming.session_table import SessionTable, upserts
from quirewise.tables import _TIDY, new_folder, written
from tests.test_collaboration import OPS, made


def table_rows(df):
    return sorted((r.uid, r.file, r.user_id, r.last_heartbeat, r.deleted, r.crdate, r.tstamp) for r in df.collect())


@pytest.mark.parametrize("seed,step", [(11, 30), (12, 6)])
def test_upserts_equal_the_replay(spark, seed, step):
    """Batches of all sizes, one without operations, some run twice, with compactions between."""
    ops = made(seed, 400, step=step)
    df, table = spark.createDataFrame(ops, OPS), SessionTable(new_folder(spark, "sessions"), 45)
    log = new_folder(spark, "log")
    write = upserts(table, log)
    cuts = [0, 40, 41, 41, 180, 330, 400]
    for batch, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
        part = df.filter((F.col("seq") >= lo) & (F.col("seq") < hi))
        write(part, batch)
        if batch in (1, 4):
            write(part, batch)
        if batch in (2, 3):
            table.compact(spark)
        if batch == 3:
            assert table_rows(table.read(spark)) == table_rows(presence.sessions(df.filter(f"seq < {hi}"), 45))
    assert table_rows(table.read(spark)) == table_rows(presence.sessions(df, 45))
    replay = spark.read.option("recursiveFileLookup", "true").schema("seq long, op string, alive boolean, uid long, is_new boolean").parquet(log)
    got = sorted((r.seq, r.alive, r.uid, r.is_new) for r in replay.filter("op <> 'leave'").collect())
    assert got == sorted((r.seq, r.alive, r.uid, r.is_new) for r in presence.replayed(df, 45).collect())


def back_and_forth(seed, n):
    """Operations whose clock goes back now and then; the first one is a join."""
    rng, rows = random.Random(seed), made(seed, n, step=6)
    return [(0, 1000, 1, "join", "f1"), *((seq, t - rng.choice((0, 0, 20, 60, 400)), user, op, file) for seq, t, user, op, file in rows[1:])]


@pytest.mark.parametrize("seed", [21, 22])
def test_upserts_where_the_clock_goes_back(spark, seed):
    df, table = spark.createDataFrame(back_and_forth(seed, 300), OPS), SessionTable(new_folder(spark, "sessions"), 45)
    for batch, (lo, hi) in enumerate(((0, 1), (1, 90), (90, 180), (180, 300))):
        table.apply(df.filter((F.col("seq") >= lo) & (F.col("seq") < hi)), batch)
        if batch == 1:
            table.compact(spark)
    assert table_rows(table.read(spark)) == table_rows(presence.sessions(df, 45))


@pytest.mark.parametrize("seed", [23, 24])
def test_lists_where_the_clock_goes_back(spark, seed, monkeypatch):
    """Chunks of a few operations, against a walk over all."""
    monkeypatch.setattr(presence, "CHUNK", 20)
    df = spark.createDataFrame(back_and_forth(seed, 300), OPS)
    names = spark.createDataFrame([(u, f"n{u}") for u in range(3)], "user_id long, user_name string")
    there, expected = {}, {}
    for r in presence.states(df, 45).orderBy("seq").collect():
        if r.alive:
            there[r.file, r.user_id] = r.t, r.uid
        elif r.op == "leave":
            there.pop((r.file, r.user_id), None)
        if r.op != "leave":
            expected[r.seq] = [(u, f"n{u}" if u < 3 else "Editor", uid) for (f, u), (t, uid) in sorted(there.items()) if f == r.file and t >= r.t - 45]
    assert {r.seq: [tuple(p) for p in r.participants] for r in presence.responses(df, names, 45).collect()} == expected


def test_disk_of_lists(spark, monkeypatch):
    """Lists that repeat each other take little room, and so do the tables and shuffles that they are made from."""
    from quirewise import tables

    rng, clients = random.Random(5), 300
    ops = [(k, 1000 + k // 50, k if k < clients else rng.randrange(clients), "join" if k < clients else "heartbeat", "f1") for k in range(900)]
    names = spark.createDataFrame([(u, f"User {u}") for u in range(clients)], "user_id long, user_name string")
    before, out = len(tables._tables), new_folder(spark, "lists")
    monkeypatch.setattr(presence, "CHUNK", 100)
    lists = presence.responses(configure(spark) and spark.createDataFrame(ops, OPS), names, 45).withColumn("participants", F.to_json("participants"))
    assert {t.split("/")[-1].split("-")[0] for t in tables._tables[before:]} == {"replay", "chunks", "heads"}
    lists.write.parquet(out)
    texts = spark.read.parquet(out).agg(F.sum(F.length("participants"))).head()[0]
    assert texts > 10_000_000
    assert sum(f.stat().st_size for f in Path(out.removeprefix("file://")).glob("*.parquet")) < texts / 30


def test_shuffles_of_a_tidy_table_go(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        found = disk.getAllFiles()
        return sum("/shuffle_" in found.apply(k).toString() for k in range(found.size()))

    before, kept = files(), spark.conf.get(_TIDY, None)
    rows = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count().repartition(5, "count")
    assert len(written(rows, "tidy", tidy=True).collect()) == 7
    for _ in range(100):  # they go beside the job
        if files() <= before:
            break
        time.sleep(0.1)
    assert files() <= before and spark.conf.get(_TIDY, None) == kept


@pytest.mark.parametrize("parts", [None, 7])
def test_largest_of_earlier_rows(spark, parts):
    rng = random.Random(6)
    rows = [(k, rng.choice((None, rng.randrange(-(2**60), 2**60)))) for k in range(300)]
    got = ranking.running_max(spark.createDataFrame(rows, "k long, v long").repartition(5), ["k"], "most", F.col("v"), "part", parts).orderBy("k").collect()
    assert [(r.k, r.v, r.most) for r in got] == [(k, v, max((w for _, w in rows[:k] if w is not None), default=None)) for k, v in rows]
    assert [r.part for r in got] == sorted(r.part for r in got)
    assert parts is None or len({r.part for r in got}) == parts


def test_a_torn_compaction_or_batch_changes_nothing(spark):
    ops = spark.createDataFrame(made(13, 120), OPS)
    table = SessionTable(new_folder(spark, "sessions"), 45)
    table.apply(ops.filter("seq < 60"), 0)
    before = table_rows(table.read(spark))
    spark.createDataFrame([], "uid long").write.parquet(f"{table.path}/snapshot/batch=0")  # a snapshot that nothing points to
    spark.createDataFrame([(1,)], "uid long").write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{table.path}/delta/batch=1")  # no _SUCCESS
    assert table_rows(table.read(spark)) == before
    table.apply(ops.filter("seq >= 60"), 1)
    table.compact(spark)
    assert table.snapshot(spark) == 1
    assert table.apply(ops.filter("seq >= 60"), 1).count() == 0
    assert table_rows(table.read(spark)) == table_rows(presence.sessions(ops, 45))


def test_an_empty_session_table(spark):
    table = SessionTable(new_folder(spark, "sessions"), 45)
    table.compact(spark)
    assert table.read(spark).count() == 0
    table.apply(spark.createDataFrame([], OPS), 0)
    table.compact(spark)
    assert table.read(spark).count() == 0


@pytest.mark.parametrize("every", [7, 1000])
def test_cadence_goes_on_where_it_stopped(spark, every):
    spark.dataSource.register(CadenceSource)
    rng = random.Random(every)
    rows = [(k, f"f{k % 3}", k % 4, o, o + rng.choice((0, 4, 5, 15, 44, 45, 300))) for k, o in enumerate(rng.randrange(100, 900) for _ in range(40))]
    folder, out, state = (new_folder(spark, n) for n in ("editors", "sent", "state"))
    spark.createDataFrame(rows, "uid long, file string, user_id long, opened long, closed long").repartition(2).write.parquet(folder)
    for until in (105, 500, 500, 2000):
        stream = spark.readStream.format("cadence").options(path=folder, since="99", until=str(until), slice=str(every)).load()
        done = streaming.run_once(spark, stream, out, state)
    expected = [(u, f, user, kind, t) for u, f, user, o, c in rows for kind, n in (("beat", 15), ("poll", 5)) for t in range(o + n, c + 1, n)]
    assert sorted(map(tuple, done.collect())) == sorted(expected)


def test_first_polls_after_a_save(spark):
    rng = random.Random(3)
    polls = [(u, f"f{u % 2}", u % 3, 1000 + u + 5 * k) for u in range(6) for k in range(40)]
    saved = [(f"f{k % 2}", k % 3, rng.randrange(990, 1230), k) for k in range(60)]
    got = streaming.newer_revisions(spark.createDataFrame(polls, "uid long, file string, user_id long, t long"), spark.createDataFrame(saved, "file string, saved_by long, t long, revision long"), 5)
    expected = [(u, f, user, t, r) for u, f, user, t in polls for g, by, s, r in saved if f == g and by != user and t - 5 < s <= t]
    assert sorted(map(tuple, got.collect())) == sorted(expected)


@pytest.mark.parametrize("slice_", ["17", "100000"])
def test_polls_come_in_runs(spark, slice_):
    """A row stands for up to so many polls; joined with saves, it gives what each poll alone would."""
    spark.dataSource.register(CadenceSource)
    rng, folder = random.Random(8), new_folder(spark, "editors")
    rows = [(k, f"f{k % 2}", k % 3, o, o + rng.choice((0, 4, 5, 44, 45, 300, 1999))) for k, o in enumerate(rng.randrange(100, 900) for _ in range(30))]
    spark.createDataFrame(rows, "uid long, file string, user_id long, opened long, closed long").repartition(2).write.parquet(folder)
    stream = spark.readStream.format("cadence").options(path=folder, since="99", until="5000", kind="poll", run=str(streaming.RUN), slice=slice_).load()
    runs = streaming.run_once(spark, stream, new_folder(spark, "sent"), new_folder(spark, "state"))
    polls = sorted((u, f, user, t) for u, f, user, o, c in rows for t in range(o + 5, c + 1, 5))
    sent = [(r.uid, r.file, r.user_id, r.t + 5 * k) for r in runs.collect() for k in range(r.n)]
    assert sorted(sent) == polls and runs.filter(f"kind <> 'poll' or n < 1 or n > {streaming.RUN}").count() == 0
    assert slice_ == "17" or runs.count() < len(polls) / 20
    saved = [(f"f{k % 2}", k % 3, rng.randrange(90, 3000), k) for k in range(200)]
    got = streaming.newer_revisions(runs, spark.createDataFrame(saved, "file string, saved_by long, t long, revision long"), 5)
    expected = [(u, f, user, t, r) for u, f, user, t in polls for g, by, s, r in saved if f == g and by != user and t - 5 < s <= t]
    assert sorted(map(tuple, got.collect())) == sorted(expected)


def test_cadence_goes_to_its_end_whatever_the_clock():
    assert CadenceReader({"path": "file:///none", "until": str(2**40)}).latestOffset() == {"t": 2**40}
    assert CadenceReader({"path": "file:///none"}).latestOffset()["t"] <= time.time()


def test_polls_and_saves_in_steps(spark, sf_dir, monkeypatch):
    """State holds what one of several runs of the stream brings, a row for a run of polls; the rows are those of the SQL."""
    import __spark_entry__
    from quirewise.plans import live_queries
    from tests.oracle import assert_same

    run_once, ran = streaming.run_once, []

    def seen(session, stream, *folders):
        ran.append(run_once(session, stream, *folders))
        return ran[-1]

    monkeypatch.setattr(streaming, "run_once", seen)
    monkeypatch.setattr(live_queries, "STATE", 300)
    df = __spark_entry__.queries()["remote_newer_stream"](spark, sf_dir)
    assert_same(df, __spark_entry__.oracle_sql()["remote_newer_stream"], sf_dir)
    assert len(ran) > 2


def test_numbers_of_saves(spark):
    rng = random.Random(4)
    asked = [(k, f"f{rng.randrange(4)}", rng.choice((-1, 0, 1, 2, 3, 7))) for k in range(300)]
    base = {"f0": 7, "f1": 2}
    got = saves.numbered(spark.createDataFrame(asked, "seq long, file string, expected long"), spark.createDataFrame(list(base.items()), "file string, revision long"))
    now, expected = dict(base), {}
    for seq, file, want in asked:
        ok = want < 0 or want == now.get(file, 0)
        now[file] = now.get(file, 0) + ok
        expected[seq] = now[file] if ok else None
    assert {r.seq: r.revision for r in got.collect()} == expected


def catalogue(spark):
    files = spark.createDataFrame([("1:/a.docx", "file", "docx", 1), ("1:/b.DOCX", "file", "DOCX", 1), ("1:/c.pdf", "file", "pdf", 1), ("1:/d", "folder", "", 1)], "file_identifier string, kind string, extension string, storage_id long")
    users = spark.createDataFrame([(1, False), (2, False), (10, True)], "uid long, is_admin boolean")
    grants = spark.createDataFrame([(1, 1, True)], "uid long, storage_id long, storage_right boolean")
    return files, users, grants


def test_a_save_is_checked_in_order(spark):
    text = base64.b64encode(b"sample-docx-binary").decode()
    body = lambda **x: json.dumps({"file": "1:/a.docx", "data": text} | x)
    rows = [
        (1, 1, "", True, 400), (2, 1, "{no", True, 400), (3, 1, body(data=""), True, 400), (4, 1, body(data="####", file="1:/none"), True, 400), (5, 1, body(file=" "), True, 400),
        (6, 1, body(file="1:/none.docx"), True, 404), (7, 1, body(file="1:/d"), True, 404), (8, 2, body(file="1:/c.pdf"), False, 415), (9, 2, body(), True, 403), (10, 1, body(), False, 403),
        (11, 1, body(revision="1"), True, 409), (12, 1, body(), True, 200), (13, 10, body(revision=1), True, 200), (14, 1, body(revision=1, file=" 1:/b.DOCX"), True, 409), (15, 1, body(revision=0, file="1:/b.DOCX"), True, 200), (16, 1, "[]", True, 400),
    ]
    requests = spark.createDataFrame([r[:4] for r in rows], "seq long, uid long, body string, file_right boolean")
    none = spark.createDataFrame([], "file string, revision long")
    got = {r.seq: r for r in saves.answered(saves.checked(requests, *catalogue(spark)), none).collect()}
    assert {k: r.status for k, r in got.items()} == {r[0]: r[4] for r in rows}
    assert [got[k].revision for k in (12, 13, 15)] == [1, 2, 1]
    assert got[12].content_hash == "4a59e91b3940fcec84dae2a55463cd86d4cf6f23c04f2023bd90aa0f076c53b6"
    assert got[14].error == "Document was updated by another editor. Reload to continue." and got[14].content_hash is None


def test_saves_that_run_again_count_once(spark):
    log, files = SaveLog(new_folder(spark, "saves")), catalogue(spark)
    write = saver(log, *files)
    body = lambda k: json.dumps({"file": "1:/a.docx" if k % 3 else "1:/b.DOCX", "data": base64.b64encode(b"v%d" % (k % 5)).decode()})
    requests = spark.createDataFrame([(k, 1, body(k), True) for k in range(30)], "seq long, uid long, body string, file_right boolean")
    assert log.done(spark) == [] and log.log(spark).count() == 0
    write(requests.filter("seq < 12"), 0)
    spark.createDataFrame([(5, "1:/a.docx", 99, "x", 1)], "uid long, file_identifier string, revision long, content_hash string, saved_by long").write.parquet(f"{log.path}/revisions/batch=1")  # died before its ledger row
    assert revisions.latest(log.log(spark)).filter("revision = 99").count() == 0
    for _ in range(2):
        write(requests.filter("seq >= 12"), 1)
    assert log.done(spark) == [0, 1]
    numbers = {f: sorted(r.revision for r in log.log(spark).collect() if r.file_identifier == f) for f in ("1:/a.docx", "1:/b.DOCX")}
    assert numbers == {"1:/a.docx": list(range(1, 21)), "1:/b.DOCX": list(range(1, 11))}
    assert log.answers(spark).count() == 30
    stored = {r.name.split(".")[0]: bytes(r.content) for r in sources.binary_files(spark, log.bytes_folder()).select("name", "content").collect()}
    import hashlib

    assert all(hashlib.sha256(b).hexdigest() == name for name, b in stored.items()) and len(stored) == 5


def test_parts_arrive_in_many_files(spark, sf_dir, monkeypatch):
    """Each micro-batch is one whole part, of as many files as any other."""
    from quirewise.plans import text_queries
    from quirewise.plans.model import Model

    monkeypatch.setattr(text_queries, "ARRIVING", 50)
    m, seen = Model(spark, sf_dir), {}

    def keep(rows, batch):
        seen[batch] = sorted(r.seq for r in rows.select("seq").collect())

    stream = text_queries.arriving(m, m.ops, "seq", streaming.OPS_SCHEMA, 3)
    assert len(stream.sparkSession.read.parquet(text_queries.in_parts(m, m.ops, "seq", 3)[0]).inputFiles()) == 18
    streaming.polling(stream, keep, new_folder(spark, "state"), every=None).awaitTermination()
    assert [x for b in sorted(seen) for x in seen[b]] == list(range(1000)) and len(seen) == 3


def test_binary_files_of_subfolders(spark):
    folder = new_folder(spark, "files")
    rows = [(f"{k % 3}/{k}.docx", b"x" * k) for k in range(20)] + [("own.docx", b"own"), ("empty.docx", b"")]
    assert sources.write_binaries(spark.createDataFrame(rows, "name string, content binary"), folder).count() == 22
    got = sorted((r.name, bytes(r.content), r.size) for r in sources.binary_files(spark, folder).collect())
    assert got == sorted((n.split("/")[-1], c, len(c)) for n, c in rows)
    named = spark.createDataFrame([("1/4.docx",), ("empty.docx",)], "name string")
    assert sorted((r.name, bytes(r.content)) for r in sources.read_binaries(named, folder).collect()) == [("1/4.docx", b"xxxx"), ("empty.docx", b"")]


def test_editors_are_dealt_over_files(spark, sf_dir):
    """Few rows stand for very many requests, so all tasks get some."""
    from quirewise.plans import live_queries
    from quirewise.plans.model import Model

    folder, first, last = live_queries.editors_folder(Model(spark, sf_dir))
    assert first < last and len(spark.read.parquet(folder).inputFiles()) > 1
