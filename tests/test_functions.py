import re

import pytest
from pyspark.sql import functions as F

from quirewise import sources
from quirewise.functions import messages, rewriting
from quirewise.functions import scalars as S
from quirewise.session import configure
from quirewise.sources import labels

EN = "{count, plural, one {1 editor online} other {# editors online}}"
DE = "{count, plural, one {1 Bearbeiter online} other {# Bearbeiter online}}"
EXACT = "{count, plural, =0 {nobody} one {one} other {# others}}"
CASES = [
    (EN, 1, "1 editor online"), (DE, 1, "1 Bearbeiter online"), (EN, 3, "3 editors online"), (DE, 7, "7 Bearbeiter online"), (EN, 0, "0 editors online"),
    (EXACT, 0, "nobody"), (EXACT, 1, "one"), (EXACT, 5, "5 others"), ("{count, plural, one {x}}", 2, ""), ("{count, plural, one {x", 1, "{count, plural, one {x"), ("Hi {name}", 1, "Hi {name}"),
]


@pytest.mark.parametrize("message,count,text", CASES)
def test_plural(spark, message, count, text):
    assert spark.range(1).select(messages.plural(F.lit(message), {"count": F.lit(count)}).alias("a")).first().a == text


def closing(text, at):
    """The place of the brace that closes the one before `at`, or -1."""
    depth = 1
    for k in range(at, len(text)):
        depth += (text[k] == "{") - (text[k] == "}")
        if not depth:
            return k
    return -1


def formatted(message, values):
    """The rules of message formatting, character by character."""
    head = re.search(r"\{(\w+)\s*,\s*plural\s*,", message, re.A)
    end = closing(message, head.end()) if head else -1
    if end >= 0:
        number, branches, at = str(values.get(head[1], 0)), {}, head.end()
        while m := re.compile(r"\s*([a-z]+|=\d+)\s*\{").match(message[:end], at):
            at = closing(message, m.end()) + 1
            branches[m[1]] = message[m.end() : at - 1]
        text = branches.get("=" + number, branches.get("one" if number == "1" else "other", branches.get("other", ""))).replace("#", number)
        parts = {"$$": "$", "$&": message[head.start() : end + 1], "$`": message[: head.start()], "$'": message[end + 1 :]}
        message = message[: head.start()] + re.sub(r"\$[$&`']", lambda m: parts[m[0]], text) + message[end + 1 :]
    return re.sub(r"\{(\w+)\}", lambda m: str(values.get(m[1], m[0])), message, flags=re.A)


SPECIAL = [
    "{n, plural, one {a} one {b} other {c}}", "{ n, plural, one {a}}", "{m, plural, one {a} =0 {none} other {#}} {a} {b}", "{n, plural, one {{a #} {{b}}} other {x}} {n}", "{n, plural, one {a} two", "{x, plural, one {a} {n, plural, one {b}}",
    "cost {n, plural, one {$$# $& $` $' $1} other {$}} end", "{a}{b}{c} { a } {}", "{n,plural,one{1}other{2}}", "{n, plural, one {a} ?? other {b}}", "{n, plural, ONE {a} other {b}}", "{n, plural, one {#} other {# {n}}} and {n, plural, one {x} other {y}}", "plain", "",
    "{n, plural, one {" + "{" * 9 + "deep #" + "}" * 9 + "} other {o}}", "{n, plural, one {a}} } {", "{n, plural, {a} other {b}}", "{n, plural, other}", "{n, plural, one {" + "{" * 9 + "}" * 8 + "}", "x {n, plural, =1{}other{y}}",
]


@pytest.mark.parametrize("number", [0, 1, 2])
def test_messages_equal_the_rules(spark, number):
    given = {"n": number, "a": "{b}", "b": "x$&"}
    rows = spark.createDataFrame([(m,) for m in SPECIAL], "m string").select("m", messages.formatted(F.col("m"), {k: F.lit(v) for k, v in given.items()}).alias("o")).collect()
    assert {r.m: r.o for r in rows} == {m: formatted(m, given) for m in SPECIAL}


def test_named_values(spark):
    row = spark.range(1).select(messages.named(F.lit("Saved to {path}"), {"path": F.lit("fileadmin/x.docx")}).alias("a"), messages.named(F.lit("Hi {name}"), {}).alias("b")).first()
    assert (row.a, row.b) == ("Saved to fileadmin/x.docx", "Hi {name}")


def test_content_hash_is_stable(spark):
    h = [spark.range(1).select(S.sha256(F.lit("sample-docx-binary")).alias("h")).first().h for _ in range(2)]
    assert h[0] == h[1] == "4a59e91b3940fcec84dae2a55463cd86d4cf6f23c04f2023bd90aa0f076c53b6"
    assert len(h[0]) == 64


def column(spark, f, values):
    configure(spark)
    return [r.o for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").orderBy("i").select(f(F.col("v")).alias("o")).collect()]


def test_names(spark):
    given = ["", "  ", ".", "a/..", "..\\x\\y", "foo/", "x.DOCX", "x.doc", ".docx", "\ttab.docx \n", None]
    assert column(spark, S.docx_name, given) == [None, None, None, None, "y.docx", "foo.docx", "x.DOCX", "x.doc.docx", ".docx", "tab.docx", None]


def test_strict_base64(spark):
    decoded = column(spark, lambda c: F.decode(S.strict_base64(c), "utf-8"), ["YQ==", "YQ", "YQ=", "####"])
    assert decoded == ["a", "a", None, None]


def test_long_base64_has_no_line_breaks(spark):
    (text,) = column(spark, lambda c: S.base64(F.encode(c, "utf-8")), ["x" * 500])
    assert "\n" not in text and "\r" not in text


def test_php_int(spark):
    assert column(spark, lambda c: S.php_int(c, -1), [None, "3", " -4", "12abc", "abc", "", "99999999999"]) == [-1, 3, -4, 12, 0, 0, 99999999999]
    assert column(spark, S.php_int, ["9" * 30, "-" + "9" * 30, "3.99", "1e3", "-.5e1x", "1e400", "."]) == [2**63 - 1, -(2**63), 3, 1000, -5, 0, 0]


def test_payloads_may_be_lists(spark):
    given = ["[1,2]", '{"file":"a"}', "[broken", "7", "", None, " [] "]
    assert column(spark, lambda c: sources.payload(c).isNotNull(), given) == [True, True, False, False, False, False, True]
    assert column(spark, lambda c: sources.payload(c)["file"], given) == [None, "a", None, None, None, None, None]
    assert column(spark, lambda c: F.size(F.map_keys(sources.manifest(c))), ["[1]", '{"a":{"file":"b"}}', "{"])[:2] == [0, 1]


def test_numbers_and_nulls_in_messages(spark):
    one = lambda c: spark.range(1).select(c.alias("o")).first().o
    assert [one(messages.formatted(F.lit(EN), {"count": F.lit(x)})) for x in (1.0, 2.0, 1.5)] == ["1 editor online", "2 editors online", "1.5 editors online"]
    assert one(messages.formatted(F.lit(EN + " {a}"), {"count": F.lit(None), "a": F.lit(None)})) == "0 editors online null"


def test_request_fields(spark):
    given = ['{"revision":true,"file":"a"}', '{"revision":[],"file":null}', '{"revision":"x","file":[1]}', "[3]", "[" * 512 + "]" * 512, "[" * 513 + "]" * 513, '{"data":"' + "[" * 600 + '"}', '"text"', "{", None]
    assert column(spark, sources.request_fields, given[:3]) == [("a", None, None, None, 1, 0), (None, None, None, None, 0, 0), ("Array", None, None, None, 0, 0)]
    assert column(spark, lambda c: sources.request_fields(c).isNotNull(), given) == [True] * 5 + [False, True] + [False] * 3


def test_lookups_read_few_rows(spark, tmp_path):
    rows = spark.range(200_000).select(F.col("id").alias("uid"), F.sha2((F.col("id") % 20_000).cast("string"), 256).alias("file_identifier"), (F.col("id") % 7).alias("revision"))
    sources.write_indexed(rows, f"file://{tmp_path}/log", row_group=200_000)
    one = spark.read.parquet(f"file://{tmp_path}/log").filter(F.col("file_identifier") == F.sha2(F.lit("77"), 256))
    assert one.count() == 10
    plan = one._jdf.queryExecution().executedPlan()
    one._jdf.queryExecution().executedPlan().executeCollect()
    scan = plan.collectLeaves().head()
    assert scan.metrics().get("numOutputRows").get().value() < 20_000


def test_toast(spark):
    labels = {"saveFailed": F.lit("Nicht gespeichert")}
    box = lambda c: S.toast(c, F.lit("a reason"), F.lit(""), F.lit("n.docx"), labels)
    got = column(spark, box, ["saved", "error", "saving", "ready", None])
    assert [r and tuple(r) for r in got] == [("success", "Saved", "n.docx"), ("error", "Nicht gespeichert", "a reason"), None, None, None]
    assert column(spark, lambda c: S.toast(c, F.lit(""), F.lit("a/b"), F.lit("n"), {})["message"], ["saved", "error"]) == ["a/b", "Save failed"]


def test_filters_of_links_keys_and_messages(spark):
    lit = lambda *x: [F.lit(v) for v in x]
    host = F.lit("https://fonts.example.com/x")
    one = lambda c: spark.range(1).select(c.alias("o")).first().o
    blocked = lambda tag, rel: one(S.link_blocked(*lit(tag, rel), host, ["fonts.example.com"]))
    assert [blocked("LINK", "StyleSheet"), blocked("LINK", "preload"), blocked("IMG", "stylesheet"), blocked("LINK", None)] == [True, False, False, False]
    assert [one(S.saves_by_key(*lit(k, c, m, s), F.lit(w))) for k, c, m, s, w in [("S", True, False, False, "1"), ("s", False, True, False, "1"), ("x", True, False, False, "1"), ("s", True, False, True, "1"), ("s", True, False, False, "0")]] == [True, True, False, False, False]
    accepts = lambda origin, action, value: one(S.accepts_message(*lit(origin, "a", action), "chosen", *lit("folder", value)))
    assert [accepts(*x) for x in [("a", "chosen", "1:/"), ("b", "chosen", "1:/"), ("a", "other", "1:/"), ("a", "chosen", "")]] == [True, False, False, False]


def test_locale_and_names(spark):
    assert column(spark, S.locale, ["", "default", "de", "de_AT", "DE", "en", None]) == ["en", "en", "de", "de", "de", "en", "en"]
    assert column(spark, lambda c: S.display_name(c, F.lit(None).cast("string")), [" Ann ", "  ", None]) == ["Ann", "Editor", "Editor"]


def test_urls(spark):
    assert column(spark, S.download_url, ["/a", "a", "http://x/y", "HTTP://x/y", "", None]) == ["/a", "/a", "http://x/y", "/HTTP://x/y", None, None]
    assert column(spark, lambda c: S.host_blocked(c, ["fonts.example.com"]), ["https://FONTS.example.com/x", "//fonts.example.com/x", "not a url", None])[::2] == [True, False]


def test_rules_apply_once_and_first_match_wins(spark):
    rules = [("a", "left:x", "left:y"), ("b", "x", "z")]
    f = lambda c: rewriting.rewrite(c, rules, "left:y")
    assert column(spark, f, ["prefix left:x left:x suffix", "only x x", "left:y x", "none"]) == ["prefix left:y left:x suffix", "only z x", None, None]
    assert column(spark, lambda c: rewriting.rewrite(f(c), rules, "left:y"), ["prefix left:x suffix"]) == [None]


def test_shapes_of_bundles(spark):
    """Each needle is replaced, and a second rewrite does nothing."""
    for rules, done in rewriting.SHAPES.values():
        for _, needle, new in rules:
            (once,) = column(spark, lambda c: rewriting.rewrite(c, rules, done), [f"prefix {needle} suffix"])
            assert once == f"prefix {new} suffix" and (needle not in once or done in once)
            assert column(spark, lambda c: rewriting.rewrite(c, rules, done), [once]) == [None]


def test_files_are_overwritten_whole(spark, tmp_path):
    folder = f"file://{tmp_path}/out"
    for content in (b"first, and longer", b"second"):
        rows = spark.createDataFrame([("a.docx", content), ("b.docx", b"b")], "name string, content binary")
        assert {tuple(r) for r in sources.write_binaries(rows, folder).collect()} == {("a.docx", len(content)), ("b.docx", 1)}
        back = {r.name: (bytes(r.content), r.status) for r in sources.checked(sources.binary_files(spark, folder)).collect()}
        assert back == {"a.docx": (content, 200), "b.docx": (b"b", 200)}
        assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a.docx", "b.docx"]
    spark.createDataFrame([("none.docx", b"")], "name string, content binary").transform(lambda x: sources.write_binaries(x, f"{folder}/below")).collect()
    empty = sources.checked(sources.binary_files(spark, folder)).filter("size = 0").collect()
    assert [(r.name, bytes(r.content), r.status) for r in empty] == [("none.docx", b"", 200)]
    rows = spark.createDataFrame([(3, b""), (3, None), (0, b""), (3, b"abc")], "size long, content binary")
    assert [r.status for r in sources.checked(rows).collect()] == [500, 500, 200, 200]


def test_responses(spark):
    given = [(200, '{"ok":true}'), (200, "<html>"), (404, '{"ok":true}'), (404, '{"ok":false,"error":"gone"}'), (500, "[]"), (200, '{"ok":false}'), (503, None)]
    rows = spark.createDataFrame([(i, s, b) for i, (s, b) in enumerate(given)], "i int, s int, b string").orderBy("i")
    got = [tuple(r.r) for r in rows.select(sources.response(F.col("s"), F.lit("text"), F.col("b")).alias("r")).collect()]
    assert got == [(True, None, 200), (False, "Invalid server response.", 200), (False, "text", 404), (False, "gone", 404), (False, "text", 500), (False, None, 200), (False, "Invalid server response.", 503)]


def test_label_source(spark, tmp_path):
    path = tmp_path / "labels.xlf"
    path.write_text('<?xml version="1.0"?><xliff><file id="d"><unit id="a.b"><segment><source>Text</source></segment></unit><unit id="c"><segment><source>Other</source></segment></unit></file></xliff>')
    assert sorted(map(tuple, labels(spark, {"en": f"file://{path}"}).collect())) == [("en", "a.b", "Text"), ("en", "c", "Other")]
