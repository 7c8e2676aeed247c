"""Presence and saves against row-by-row simulators."""

import random
import time

import pytest
from pyspark.sql import functions as F

from quirewise import streaming
from quirewise.operators import files, presence, ranking, revisions
from quirewise.plans import catalog
from quirewise.plans.model import Model
from quirewise.plans.text_queries import _ops_stream
from quirewise.session import configure
from quirewise.sources import polled
from quirewise.tables import new_folder, scratch, shared_dir, written

OPS = "seq long, t long, user_id long, op string, file string"


def simulate(ops, ttl):
    """What the session table did, one operation after another."""
    return simulated(ops, ttl)[0]


def simulated(ops, ttl):
    """(replay, table, answers): answers are the participants that each request gets, by seq."""
    table, client, out, answers = [], {}, [], {}  # rows: [uid, file, user, last, live]
    for seq, t, user, op, file in ops:
        mine = next((r for r in table if r[1] == file and r[2] == user and r[4]), None)
        if op == "join":
            if mine:
                mine[3], new = t, False
            else:
                mine, new = [seq, file, user, t, True], True
                table.append(mine)
            client[file, user] = mine
        elif op == "heartbeat":
            if (file, user) not in client:
                continue
            mine, new = client[file, user], False
            if mine[4]:
                mine[3] = t
        elif op == "leave":
            gone = client.pop((file, user), None)
            for r in table:
                if r is gone or r[1] == file and r[2] == user:
                    r[4] = False
            continue
        else:
            continue
        alive = mine[4]
        for r in table:
            if r[4] and r[3] < t - ttl:
                r[4] = False
        out.append((seq, op, alive, mine[0], new))
        answers[seq] = sorted((r[2], r[0]) for r in table if r[1] == file and r[4] and r[3] >= t - ttl)
    return out, table, answers


def made(seed, n=600, users=4, files=3, step=40):
    rng, t, rows = random.Random(seed), 1000, []
    for seq in range(n):
        t += rng.randrange(step)
        rows.append((seq, t, rng.randrange(users), rng.choices(("join", "heartbeat", "leave", "save"), (2, 5, 1, 2))[0], f"f{rng.randrange(files)}"))
    return rows


@pytest.mark.parametrize("seed,step", [(1, 40), (2, 8), (3, 3)])
def test_replay_equals_the_simulator(spark, seed, step):
    ops = made(seed, step=step)
    got = presence.replayed(spark.createDataFrame(ops, OPS), 45).orderBy("seq").collect()
    assert [(r.seq, r.op, r.alive, r.uid, r.is_new) for r in got] == simulate(ops, 45)


@pytest.mark.parametrize("seed,step", [(1, 40), (2, 8), (6, 3)])
def test_sessions_and_answers_equal_the_simulator(spark, seed, step):
    ops = made(seed, step=step)
    df = spark.createDataFrame(ops, OPS)
    _, table, answers = simulated(ops, 45)
    got = presence.sessions(df, 45).collect()
    assert sorted((r.uid, r.file, r.user_id, r.last_heartbeat, not r.deleted) for r in got) == sorted(map(tuple, table))
    early = [op for op in ops if op[1] <= 3000]
    assert sorted((r.uid, r.last_heartbeat, not r.deleted) for r in presence.sessions(df, 45, 3000).collect()) == sorted((r[0], r[3], r[4]) for r in simulated(early, 45)[1])
    names = spark.createDataFrame([(0, "Ann"), (1, "Bob")], "user_id long, user_name string")
    answered = {r.seq: [(p.userId, p.sessionUid) for p in r.participants] for r in presence.responses(df, names, 45).collect()}
    assert answered == answers


def test_running_over_partitions(spark):
    """Sums, maxima and numbers over an order and within groups, one of which holds most rows; gaps in the order."""
    rows = [(i * i, (i * 37) % 101 if i % 5 else None, "hot" if i % 7 else f"g{i % 3}") for i in range(300)]
    df = spark.createDataFrame(rows, "seq long, v long, g string").repartition(5)
    spread = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        whole = ranking.running(df, ["seq"], {"m": (F.max, F.col("v")), "s": (F.sum, F.col("v"))}).orderBy("seq").collect()
        own = ranking.running(df, ["seq"], {"s": (F.sum, F.col("v"))}, ["g"]).collect()
        numbers = ranking.numbered(df, ["seq"], ["g"], "n").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", spread)
    before = lambda i, g=None: [v for _, v, h in rows[:i] if v is not None and g in (None, h)]
    assert [(r.m, r.s) for r in whole] == [(max(before(i), default=None), sum(before(i)) if before(i) else None) for i in range(300)]
    at = {r[0]: i for i, r in enumerate(rows)}
    assert all(r.s == (sum(x) if (x := before(at[r.seq], r.g)) else None) for r in own) and len(own) == 300
    assert all(r.n == 1 + sum(h == r.g for _, _, h in rows[: at[r.seq]]) for r in numbers)


def test_scratch_tables_go(spark):
    with scratch(spark) as keep:
        a, b = (written(spark.range(5), n) for n in "ab")
        keep.append(b)
    assert b.count() == 5 and spark.range(1).count() == 1
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist|FILE_NOT_EXIST"):
        a.count()


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Session:
        class sparkContext:
            master = "spark://host:7077"

        class conf:
            get = staticmethod(lambda name, default: None)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session)


def names_by_steps(rows):
    """Given names first; each further file takes the next free suffix of its name."""
    used = {}
    for _, folder, name in rows:
        used.setdefault(folder, set()).add(name)
    seen, out = set(), []
    for i, folder, name in sorted(rows):
        if (folder, name) not in seen:
            seen.add((folder, name))
            out.append((i, name))
            continue
        end = name[-5:] if name.lower().endswith(".docx") else ""
        base, k = name[: len(name) - len(end)], 1
        while f"{base}_{k:02d}{end}" in used[folder]:
            k += 1
        used[folder].add(f"{base}_{k:02d}{end}")
        out.append((i, f"{base}_{k:02d}{end}"))
    return out


def test_names_never_collide(spark):
    names = ["a.docx", "a.docx", "a_01.docx", "a_01.docx", "a.DOCX", "a.DOCX", "a_03.docx", "a.docx", "a.docx", "plain", "plain", "a_1.docx", "a_00.docx", "a_02"] + ["b.docx"] * 105 + ["b_99.docx", "b_100.docx"]
    rows = [(i, f"f{i % 2}" if i < 14 else "f", n) for i, n in enumerate(names)] + [(500 + i, "f0", n) for i, n in enumerate(names[:14])]
    got = files.without_collisions(spark.createDataFrame(rows, "k long, folder string, name string"), "k").collect()
    assert sorted((r.k, r.stored_name) for r in got) == sorted(names_by_steps(rows))
    assert len({(r.folder, r.stored_name) for r in got}) == len(rows)


def test_files_without_editors_have_an_empty_list(spark):
    rows = spark.createDataFrame([("f", 1, 5), ("f", 2, 3)], "file string, user_id long, uid long")
    names = spark.createDataFrame([(1, "Ann")], "user_id long, user_name string")
    got = {r.file: [tuple(p) for p in r.participants] for r in presence.participants(rows, names, spark.createDataFrame([("f",), ("empty",)], "file string")).collect()}
    assert got == {"f": [(1, "Ann", 5), (2, "Editor", 3)], "empty": []}


def test_a_batch_that_runs_again_counts_once(spark, sf_dir):
    path = new_folder(spark, "log")
    write = streaming.session_log(path)
    rows = spark.createDataFrame(made(9, 50), OPS)
    for batch, part in ((0, rows.filter("seq < 20")), (1, rows.filter("seq >= 20")), (1, rows.filter("seq >= 20"))):
        write(part, batch)
    assert spark.read.schema(OPS).parquet(path).count() == 50


def test_ttl_edge(spark):
    rows = spark.createDataFrame([("f", u, "h", 1000 - a, False, 0) for u, a in enumerate((44, 45, 46))], "file string, user_id long, file_hash string, last_heartbeat long, deleted boolean, crdate long")
    assert sorted(r.user_id for r in presence.active(rows, 1000).collect()) == [0, 1]
    assert sorted(r.user_id for r in presence.purged(rows, 1000).filter("deleted").collect()) == [2]


def test_conflicts(spark):
    rows = spark.createDataFrame([(None, 0), (-1, 3), (3, 3), (2, 3), (4, 3), (0, 0)], "e int, c int")
    assert [r.o for r in rows.select(F.coalesce(revisions.is_conflict(F.col("e"), F.col("c")), F.lit(False)).alias("o")).collect()] == [False, False, False, True, True, False]


def folded(ops):
    state, out = {}, []
    for seq, _, user, op, file in ops:
        s = state.setdefault(file, {"c": 0, "known": {}})
        if op == "join":
            s["known"][user] = s["c"]
        elif op == "save":
            status = "skipped" if user not in s["known"] else "accepted" if s["known"][user] == s["c"] else "conflict"
            if status == "accepted":
                s["c"] += 1
                s["known"][user] = s["c"]
            out.append((seq, file, user, status, s["c"]))
    return out


def test_saves_equal_the_fold(spark):
    ops = made(5)
    got = revisions.replayed(spark.createDataFrame(ops, OPS)).orderBy("seq").collect()
    assert [tuple(r) for r in got] == folded(ops)


def test_saves_stream_over_many_batches(spark, sf_dir):
    m = Model(configure(spark), sf_dir)
    folder = new_folder(spark, "ops")
    for part in range(3):  # files arrive one after another, as operations do
        m.ops.filter(f"seq % 1000 div 334 = {part}").coalesce(1).write.mode("append").parquet(folder)
        time.sleep(1.1)
    stream = streaming.fold_saves(polled(spark, folder, streaming.OPS_SCHEMA, 1))
    got = streaming.run_once(spark, stream, new_folder(spark, "saves"), new_folder(spark, "state"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, revisions.replayed(m.ops).collect()))


@pytest.fixture
def rocksdb(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(name)


def test_saves_in_the_state_store(spark, sf_dir, rocksdb):
    m = Model(configure(spark), sf_dir)
    got = streaming.run_once(spark, streaming.replayed_saves(_ops_stream(m)), new_folder(spark, "saves"), new_folder(spark, "state"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, revisions.replayed(m.ops).collect()))


def test_presence_events(spark, sf_dir, rocksdb):
    m, ttl = Model(configure(spark), sf_dir), 21_600
    got = streaming.run_once(spark, streaming.presence_events(_ops_stream(m), ttl), new_folder(spark, "events"), new_folder(spark, "state"))
    live, events = {}, set()
    ops = [tuple(r) for r in m.ops.select("seq", "t", "user_id", "op", "file").orderBy("seq").collect()]
    for seq, t, user, op, file in ops:
        key = (file, user)
        if op != "save" and key in live and t - live[key][1] > ttl:
            uid, last = live.pop(key)
            events.add((*key, uid, "expired", last + ttl + 1))
        if op == "join" and key not in live:
            live[key] = [seq, t]
            events.add((*key, seq, "joined", t))
        elif op in ("join", "heartbeat") and key in live:
            live[key][1] = t
        elif op == "leave" and key in live:
            events.add((*key, live.pop(key)[0], "left", t))
    due = {(*key, uid, "expired", last + ttl + 1) for key, (uid, last) in live.items()}
    emitted = {tuple(r) for r in got.collect()}
    assert events <= emitted <= events | due


def test_presence_stream_is_the_batch_without_open_sessions(spark, sf_dir):
    m = Model(configure(spark), sf_dir)
    got = streaming.run_once(spark, streaming.presence_windows(_ops_stream(m), 45), new_folder(spark, "w"), new_folder(spark, "s"))
    whole = {tuple(r) for r in presence.windows(m.ops, 45).collect()}
    emitted = {tuple(r) for r in got.collect()}
    assert emitted <= whole
    last = max(r[2] for r in whole)
    assert all(r[2] >= last - 700 for r in whole - emitted)


def test_rows_too_late_are_counted(spark):
    folder = new_folder(spark, "late")
    for k, t in enumerate((100_000, 200_000, 5)):
        spark.createDataFrame([(k, t, 1, "join", "f")], OPS).write.mode("append").parquet(folder)
        time.sleep(1.1)
    stream = streaming.presence_windows(polled(spark, folder, streaming.OPS_SCHEMA, 1), 45)
    query = streaming.polling(stream, lambda rows, batch: rows.write.format("noop").mode("overwrite").save(), new_folder(spark, "state"), every=None)
    query.awaitTermination()
    assert streaming.dropped_rows(query) == 1


def test_empty_operations(spark):
    none = spark.createDataFrame([], OPS)
    for df in (presence.replayed(none), presence.sessions(none), presence.windows(none, 45), revisions.replayed(none)):
        assert df.count() == 0


def test_every_user_and_document_is_judged(spark, sf_dir):
    users = spark.createDataFrame([(1, False), (10, True), (2, False)], "uid long, is_admin boolean")
    grants = spark.createDataFrame([(2, 1, True, True)], "uid long, storage_id long, storage_right boolean, may_add boolean")
    held = spark.createDataFrame([(7, 1)], "doc_id long, storage_id long")
    requests = spark.createDataFrame([("no grant", 1, 7, True), ("admin", 10, 7, True), ("granted", 2, 7, True), ("no file right", 2, 7, False), ("no file", 2, 8, True), ("no user", 3, 7, True)], "request_id string, uid long, doc_id long, file_right boolean")
    got = {r.request_id: r[3:] for r in files.judged(requests, held, users, grants).collect()}
    refused = (403, "0", False, "viewing")
    assert got == {"no grant": refused, "admin": (200, "1", False, "editing"), "granted": (200, "1", True, "editing"), "no file right": refused, "no file": (404, "0", False, "viewing"), "no user": refused}
    answers = catalog.QUERIES["acl_requests"](spark, sf_dir)
    ids = lambda name, c: {r[0] for r in spark.read.parquet(f"{sf_dir}/{name}.parquet").select(c).collect()}
    judged = answers.select("request_id", "uid", "doc_id").collect()
    assert ids("customer", "c_custkey") <= {r.uid for r in judged}
    assert ids("documents", "doc_id") == {r.doc_id for r in judged if r.request_id.startswith("d")}


def test_presence_stream_emits_all_sessions(spark, sf_dir):
    got = catalog.QUERIES["presence_stream"](spark, sf_dir).collect()
    whole = presence.windows(Model(configure(spark), sf_dir).ops, 21_600).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, whole))


def test_sessions_are_kept_in_groups(spark, rocksdb, monkeypatch):
    """The state of many clients lies in few groups, and says who is there."""
    from quirewise.tables import new_folder

    monkeypatch.setattr(streaming, "GROUPS", 2)
    folder, checkpoint = new_folder(spark, "ops"), new_folder(spark, "state")
    spark.createDataFrame([(u, 1000 + u, u, "join", "f") for u in range(30)] + [(30, 1040, 4, "leave", "f"), (31, 1041, 5, "heartbeat", "f")], OPS).coalesce(1).write.parquet(folder)
    stream = spark.readStream.schema(OPS).parquet(folder)
    events = streaming.run_once(spark, streaming.presence_events(stream, 45), new_folder(spark, "events"), checkpoint)
    assert events.filter("event = 'joined'").count() == 30
    state = streaming.state_of(spark, checkpoint, "session")
    assert state.select("key").distinct().count() <= 2
    assert {r.user_id: r.last for r in state.select("list_element.*").collect()} == {u: 1041 if u == 5 else 1000 + u for u in range(30) if u != 4}
