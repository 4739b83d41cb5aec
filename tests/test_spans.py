"""Rules, spans, scoring, redaction: against Python's own regexes and literal cases."""

import re
import time

import pytest
from pyspark.sql import functions as F

from veilspark.config import Config, CustomRule
from veilspark.functions import checksums, normalcy, normalise
from veilspark.functions.names import find
from veilspark.functions.rules import CATALOGUE
from veilspark.functions.spans import merged, rule_spans
from veilspark.operators import review, structured
from veilspark.operators.audit import audit, totals
from veilspark.operators.detect import detect, preflight, spans_frame
from veilspark.operators.scrub import from_map_json, leaks, map_json, restore, restored, scrub, scrub_messages
from veilspark.plans.sql import CHECK_VALUES, RULE_TEXTS
from veilspark.streaming.state import admit, open_end, step

MORE = ("é123-45-6789 123-45-6789é", "😀 mail a@b.co 😀 c@d.org", "passport no: AB1234567 MRN: X12345", "policy # A1234 NINO AB 12 34 56 C", "fe80::1%eth0 ::1 2001:db8::8a2e:370:7334", "driver's license: D1234567 ID number: L01X00T47A RAMQ ABCD12345", "-----BEGIN RSA PRIVATE KEY-----\nx\n-----END RSA PRIVATE KEY-----")


def test_catalogue_is_whole():
    assert len(CATALOGUE) == 67 and len({r.name for r in CATALOGUE}) == 67
    assert [sum(r.level == k for r in CATALOGUE) for k in range(3)] == [23, 36, 8]


def test_spans_equal_python_regexes(spark):
    texts = [*RULE_TEXTS, *MORE]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").select("id", rule_spans(F.col("text"), list(CATALOGUE)).alias("s")).collect()
    for row in rows:
        want = []
        for r in CATALOGUE:
            for m in re.finditer(r.regex, texts[row.id], re.I if r.fold else 0):
                g = 1 if m.re.groups else 0
                want.append((r.name, m.start(g), m.end(g), m.group(g)))
        assert [(s.rule, s.start, s.end, s.text) for s in row.s] == want, texts[row.id]


def test_checksums(spark):
    want = {"credit_card": [1, 0, 1, 0, 0, 1], "iban": [1, 0, 1, 1, 0, 0], "finland_hetu": [1, 0, 0, 0, 0], "spain_dni": [1, 0, 0, 0], "spain_nie": [1, 1, 0, 0, 0], "uk_nhs": [1, 0, 1, 0, 0], "brazil_cpf": [1, 0, 0, 0, 0]}
    for name, ok in want.items():
        got = spark.createDataFrame(list(enumerate(CHECK_VALUES[name])), "id int, v string").select("id", F.coalesce(checksums.CHECKS[name](F.col("v")), F.lit(False)).alias("ok")).orderBy("id").collect()
        assert [int(r.ok) for r in got] == ok, name


def test_detection_keeps_no_overlaps_and_handles_nulls(spark):
    df = spark.createDataFrame([(1, "mail jo@example.org or 10.0.0.1, card 4111 1111 1111 1111"), (2, None), (3, ""), (4, "reach jo [at] example [dot] com now")], "doc_id int, text string")
    rows = {r.doc_id: r.spans for r in spans_frame(df, config=Config(level="aggressive")).collect()}
    assert [s.type for s in rows[1]] == ["EMAIL", "IP", "CREDIT_CARD"] and rows[2] == [] and rows[3] == []
    assert any(s.layer == "obfuscation" and s.type == "EMAIL" for s in rows[4])
    assert preflight(df.where("doc_id = 1")) and not preflight(df.where("doc_id = 3"))
    odd = detect(df, config=Config(level="minimal", custom_rules=(CustomRule("head", r"reach (\w+) \[at"), CustomRule("nest", r"(?:com (\w+))")), domain_parsers=False, second_pass=False)).where("rule in ('head', 'nest')").collect()
    assert {(r.rule, r.start, r.end, r.match) for r in odd} == {("head", 6, 8, "jo"), ("nest", 32, 35, "now")}
    own = detect(df, config=Config(custom_rules=(CustomRule("word", r"\breach\b"),), known_names=("jo",), second_pass=False)).where("rule in ('word', 'known_name')").collect()
    assert {(r.doc_id, r.rule) for r in own} >= {(4, "word"), (4, "known_name")}


def test_scrub_and_restore(spark):
    df = spark.createDataFrame([(1, "a@b.org then c@d.org then A@B.org"), (2, "none"), (3, None)], "doc_id int, text string")
    rows = {r.doc_id: r for r in restore(scrub(df, config=Config(domain_parsers=False))).collect()}
    assert rows[1].sanitized == "[EMAIL_1] then [EMAIL_2] then [EMAIL_1]" and rows[1].placeholders == {"[EMAIL_1]": "A@B.org", "[EMAIL_2]": "c@d.org"}
    assert rows[1].pii_count == 3 and rows[1].pii_summary == {"EMAIL": 3} and rows[2].restored == "none" and rows[3].sanitized is None
    assert leaks(scrub(df)).count() == 0
    odd = spark.createDataFrame([("[A_1] x [B_2]", {"[A_1]": "[B_2]", "[B_2]": "z"})], "t string, m map<string,string>")
    assert odd.select(restored(F.col("t"), F.col("m"), one_pass=True)).first()[0] == "[B_2] x z"
    assert odd.select(from_map_json(map_json(F.col("m")))).first()[0] == {"[A_1]": "[B_2]", "[B_2]": "z"}


def test_messages_share_a_numbering(spark):
    df = spark.createDataFrame([(1, 0, "x@y.org"), (1, 1, "p@q.org and X@y.org"), (2, 0, "p@q.org"), (2, 1, None)], "conv_id int, turn int, text string")
    got = {(r.conv_id, r.turn): r.sanitized for r in scrub_messages(df, config=Config(domain_parsers=False)).collect()}
    assert got == {(1, 0): "[EMAIL_1]", (1, 1): "[EMAIL_2] and [EMAIL_1]", (2, 0): "[EMAIL_1]", (2, 1): None}


def test_tables(spark):
    assert structured.classify("patient_id") == "NAME" and structured.classify("id") is None and structured.classify("zip") == "ZIPCODE"
    df = spark.createDataFrame([("Ann", "ann@x.org", "call ann@x.org", 5), (None, "", "x", 6)], "full_name string, e_mail string, notes string, n int")
    rows = structured.scrub_table(df, config=Config(domain_parsers=False)).orderBy("n").collect()
    assert (rows[0].full_name, rows[0].e_mail, rows[0].notes, rows[0].n) == ("[NAME_1]", "[EMAIL_1]", "call [EMAIL_1]", 5)
    assert (rows[1].full_name, rows[1].e_mail, rows[1].notes) == (None, "", "x")


def test_audit_has_no_values(spark):
    df = spark.createDataFrame([(1, "a@b.org"), (2, "nothing")], "doc_id int, text string")
    records = audit(df, at="2024-01-01")
    assert "original_values" not in records.columns and len(records.first().text_hash) == 16
    assert [(r.type, r.n) for r in totals(records).collect()] == [("EMAIL", 1)]


def test_normalcy_and_regions(spark):
    df = spark.createDataFrame([(" ",), ("",), ("the cat and the dog",), ("Zxqv Bmtr Kkpl",)], "text string")
    scores = [[w.score for w in r[0]] for r in df.select(normalcy.windows(F.col("text"))).collect()]
    assert scores[0] == [1.0] and scores[1] == [] and scores[2] == pytest.approx([0.21]) and scores[3] == [0.0]
    pairs = spark.sql("select array(named_struct('start', 5, 'end', 7), named_struct('start', 0, 'end', 5), named_struct('start', 9, 'end', 10)) a")
    assert [(r.start, r.end) for r in pairs.select(merged(F.col("a"))).first()[0]] == [(0, 7), (9, 10)]


def test_normalisation(spark):
    df = spark.createDataFrame([(0, "five five five dash one two"), (1, "one dot two"), (2, "jo (at) x dot org")], "id int, text string")
    got = [r[1] for r in df.select("id", normalise.normalised(F.col("text"))).orderBy("id").collect()]
    assert got == ["555-12", "one.two", "jo@x.org"]


def test_names_and_review():
    assert [(a, b) for a, b, _ in find("met Anna Virtanen and J. Smith")] == [(4, 17), (22, 30)]
    assert find("The the and of") == []
    text, regions = review.marked("call Bob Ray now", [(6, 8)])
    assert text == "call >>>Bob<<< Ray now" and regions == [(5, 8)]
    assert review.located('```json\n[{"text": "bob", "type": "person"}]\n```', "call Bob now", [(5, 8)]) == [(5, 8, "NAME", 0.5)]
    long = "First sentence here. Second one, with a comma and words " * 5
    parts = review.chunks(long, [(0, len(long))])
    assert [(s, e) for *_, s, e in parts][0][0] == 0 and all(e - s <= 120 for *_, s, e in parts) and "".join(long[s:e] for *_, s, e in parts) == long
    assert all(a <= s and b >= e and (a == 0 or long[a] in " .") for a, b, s, e in parts) and long[parts[0][2] : parts[0][3]].endswith(". ")
    assert review.replies('{"text": "a"}\n{"text": "b"},\nnoise [1, {"text": "c"}] [broken') == [{"text": "a"}, {"text": "b"}, {"text": "c"}]
    assert review.located('[{"text": "Bob.", "type": "x", "region": 1, "confidence": 1}]', "Bob is bob", [(0, 10)]) == [(0, 3, "X", 1.0)]
    assert review.replies("nothing") == [] and review.replies('{"pii": [{"text": "x"}]}') == [{"text": "x"}]


def test_fragments_and_limits():
    held, out = "", []
    for part in ("hi [EMA", "IL_1", "] and arr[0]", " [X"):
        text, held = step(held, part, {"[EMAIL_1]": "a@b.org"}, open_end())
        out.append(text)
    assert "".join(out) == "hi a@b.org and arr[0] " and held == "[X"
    assert admit([0.0, 1.0, 2.0, 60.5], 2)[0] == [(True, 0), (True, 0), (False, 58), (True, 0)]


def assert_rows(spark, query, table, n):
    """Waits for rows of a stream that, having timeouts, never says it is done."""
    until = time.time() + 90
    while spark.table(table).count() < n and query.isActive and time.time() < until:
        time.sleep(0.5)
    query.stop()
    assert query.exception() is None and spark.table(table).count() == n


def test_stream_of_fragments(spark, tmp_path):
    from veilspark.streaming.state import restore_fragments

    (tmp_path / "in").mkdir()
    row = '{"stream_id":"s","channel":"c","seq":%d,"frag":"%s","last":%s,"placeholders":{"[A_1]":"Ann"}}'
    (tmp_path / "in/1.json").write_text(row % (1, "to [A", "false"))
    (tmp_path / "in/2.json").write_text(row % (2, "_1] bye", "true"))
    frames = spark.readStream.schema("stream_id string, channel string, seq long, frag string, last boolean, placeholders map<string,string>").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    query = restore_fragments(frames).writeStream.format("memory").queryName("restored_parts").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    assert_rows(spark, query, "restored_parts", 2)
    assert "".join(r.emitted for r in spark.sql("select * from restored_parts order by seq").collect()) == "to Ann bye"


def test_limits_of_a_stream_and_of_principals(spark, tmp_path):
    from veilspark.operators.gateway import authorised, checked_size
    from veilspark.streaming.state import daily_quota, rate_limit, rate_limit_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.json").write_text("\n".join('{"principal":"%s","ts":"2024-01-01T00:00:%02d","rpm":%d}' % (who, k, rpm) for who, rpm in (("a", 2), ("b", 0)) for k in range(4)))
    schema = "principal string, ts timestamp, rpm long"
    query = rate_limit_stream(spark.readStream.schema(schema).json(str(tmp_path / "in")), "rpm").writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    assert_rows(spark, query, "limited", 8)
    want = [("a", True), ("a", True), ("a", False), ("a", False), *[("b", True)] * 4]
    assert [(r.principal, r.admitted) for r in spark.sql("select * from limited order by principal, ts").collect()] == want
    rows = spark.read.schema(schema).json(str(tmp_path / "in")).withColumn("id", F.monotonically_increasing_id()).withColumn("tokens", F.lit(5))
    assert [(r.key, r.admitted) for r in rate_limit(rows, "rpm", "principal", "ts", "id").orderBy("key", "ts").collect()] == want
    assert [(r.key, r.admitted) for r in daily_quota(rows.withColumn("quota", F.col("rpm") * 5), "quota", "principal", "ts", "tokens", "id").orderBy("key", "id").collect()] == want
    asked = spark.createDataFrame([("k", None, ["x"]), (None, "Bearer k", ["y" * 9]), ("z", None, ["y" * 9])], "x_api_key string, authorization string, texts array<string>")
    keys = spark.createDataFrame([("k", "n", 1, 1)], "key string, name string, rpm int, daily_token_quota int")
    assert sorted(r.status for r in checked_size(authorised(asked, keys), F.col("texts"), 5).collect()) == [200, 401, 413]


def test_saved_maps_go_on(spark):
    from veilspark.operators.scrub import scrub_on

    df = spark.createDataFrame([("c@d.org and a@b.org and e@f.org", '{"format":"[{type}_{id}]","mappings":{"[EMAIL_4]":"A@b.org"},"counters":{"EMAIL":4}}'), ("x@y.org", None)], "text string, m string")
    rows = scrub_on(df, "m", config=Config(domain_parsers=False, second_pass=False)).collect()
    assert rows[0].sanitized == "[EMAIL_6] and [EMAIL_4] and [EMAIL_5]" and rows[0].placeholders == {"[EMAIL_4]": "A@b.org", "[EMAIL_5]": "e@f.org", "[EMAIL_6]": "c@d.org"}
    assert rows[1].sanitized == "[EMAIL_1]" and rows[1].placeholders == {"[EMAIL_1]": "x@y.org"}
