import datetime as dt

from pyspark.sql import functions as F

from mnemolake.functions import classify as cl
from mnemolake.functions import redaction as rd
from mnemolake.functions import text as tx
from mnemolake.functions import timeparse as tp
from mnemolake.plans import forgetting as fg

NOW = dt.datetime(2024, 2, 1, 12, tzinfo=dt.timezone.utc).timestamp()


def one(spark, text, expr):
    return spark.createDataFrame([(text,)], "t string").select(expr(F.col("t")).alias("r")).first()["r"]


def test_lemma_and_canonical(spark):
    words = ["running", "walked", "stopped", "stories", "boxes", "cats", "glass", "children", "went", "king", "sing"]
    want = ["run", "walk", "stop", "story", "box", "cat", "glass", "child", "go", "king", "sing"]
    rows = spark.createDataFrame(list(enumerate(words)), "i int, w string").select("i", tx.lemma(F.col("w")).alias("l")).orderBy("i")
    assert [r["l"] for r in rows.collect()] == want
    assert one(spark, "The Dogs' house", tx.canonical) == "dogs' house"
    assert one(spark, " NYC ", tx.canonical) == "new york"
    assert one(spark, "an Alice's", tx.canonical) == "alice"
    assert one(spark, "the boss", lambda c: tx.canonical(c, {"boss": "Dana Lee"})) == "Dana Lee"


def test_query_tokens_keep_repeats(spark):
    assert one(spark, "The fox and the FOX-trot 2", tx.query_tokens) == ["fox", "fox", "trot", "2"]


def test_project_tags(spark):
    assert one(spark, "see #Alpha_1, project beta and project: project-gamma", tx.project_tags) == [
        "project:alpha1", "project:beta", "project:gamma",
    ]


def test_egress_redaction(spark):
    text = "mail a.b@c.org, ssn 123-45-6789, ip 10.0.0.1, card 4111 1111 1111 1111"
    out = one(spark, text, rd.redact_egress)
    assert out == "mail [REDACTED_EMAIL], ssn [REDACTED_SSN], ip [REDACTED_IP], card [REDACTED_CREDIT_CARD]"
    strict = one(spark, "DE44500105175407324931", lambda c: rd.redact_egress(c, "strict"))
    assert strict == "[REDACTED_IBAN]"


def test_pii_detection_checks_luhn(spark):
    found = one(spark, "ok 4111 1111 1111 1111 bad 4111 1111 1111 1112 at 12 Main Street", rd.pii_found)
    assert [(h["type"], h["value"]) for h in found] == [
        ("credit_card", "4111 1111 1111 1111"), ("address", "12 Main Street"),
    ]
    assert one(spark, "write to x@y.org now", rd.redact_pii) == "write to [REDACTED-EMAIL] now"


def test_share_and_sensitive(spark):
    assert one(spark, "Ann Lee paid 1,200", lambda c: rd.redact_share(c, "names")) == "[NAME] paid 1,200"
    assert one(spark, "Ann paid 1,200", lambda c: rd.redact_share(c, "numbers")) == "Ann paid [NUM]"
    assert one(spark, "my daughter goes to high school", rd.sensitive_topic) == "school"
    assert one(spark, "nothing here", rd.sensitive_topic) is None


def test_router(spark):
    cases = [
        ("I love dark roast coffee", "preference", 0.9, "stored"),
        ("We decided to ship on Monday", "decision", 0.9, "stored"),
        ("ok", None, None, "ignored_fluff"),
        ("password: hunter2", None, None, "rejected_secret"),
        ("the deploy failed to start", "outcome", 0.9, "stored"),
        ("zzz qqq rrr", "fact", 0.0, "queued"),
        ("no actually that's wrong", "correction", 0.95, "stored"),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, t string")
    rows = df.select("i", cl.signals(F.col("t")).alias("s")).select("i", "s", cl.route(F.col("s")).alias("r")).orderBy("i").collect()
    for row, (_, category, conf, result) in zip(rows, cases):
        assert row["r"] == result
        if category:
            assert (row["s"]["category"], row["s"]["confidence"]) == (category, conf)


def test_time_arguments():
    utc = dt.timezone.utc
    assert tp.to_epoch("2024-03", NOW) == dt.datetime(2024, 3, 1, tzinfo=utc).timestamp()
    assert tp.to_epoch("Sept 2023", NOW) == dt.datetime(2023, 9, 1, tzinfo=utc).timestamp()
    assert tp.to_epoch("last month", NOW) == dt.datetime(2024, 1, 1, tzinfo=utc).timestamp()
    assert tp.to_epoch("nonsense", NOW) is None
    assert tp.month_range("December 2023")[1] == dt.datetime(2024, 1, 1, tzinfo=utc).timestamp()
    assert [tp.range_days(x) for x in ("2w", "1q", "3h", None)] == [14, 90, 1, 30]
    assert tp.temporal_mode("during:2024-01:2024-02", NOW)[0] == "during"
    assert tp.temporal_mode("during:oops", NOW)[0] == "all"
    assert tp.temporal_mode("2024-01-05", NOW)[0] == "as_of"


def test_time_column(spark):
    got = one(spark, "2024-03-05", tp.parse_column)
    assert got == dt.datetime(2024, 3, 5, tzinfo=dt.timezone.utc).timestamp()
    assert one(spark, "march 2024", tp.parse_column) == dt.datetime(2024, 3, 1, tzinfo=dt.timezone.utc).timestamp()
    assert one(spark, "12.5", tp.parse_column) == 12.5


def test_forget_commands():
    assert fg.parse_command("forget everything older than 30 days") == ("time", {"when": "30 days"})
    assert fg.parse_command("delete my preferences about food") == ("type", {"kind": "preference", "topic": "food"})
    assert fg.parse_command("forget everything about my old job") == ("topic", {"topic": "my old job"})
    assert fg.parse_command("that changed, I moved")[0] == "update"
    assert fg.parse_command("forget my phone number") == ("fact", {"topic": "my phone number"})
    assert fg.cutoff("30 days", NOW) == NOW - 30 * 86400
    assert fg.cutoff("1/31/2024", NOW) == dt.datetime(2024, 1, 31, tzinfo=dt.timezone.utc).timestamp()


def test_redaction_changes_the_detected_span_only(spark):
    card = "4111 1111 1111 1111"
    got = one(spark, f"x-{card}-9 and {card}.", rd.redact_pii)
    assert got == f"x-{card}-9 and [REDACTED-CREDIT_CARD]."


def _refs(spark, rows, **options):
    from mnemolake.operators import references

    texts = spark.createDataFrame(rows, "g long, p long, text string")
    return sorted((r["g"], r["p"], r["pronoun"], r["referent"]) for r in references.referents(texts, "g", "p", **options).collect())


def test_pronouns(spark):
    from mnemolake.operators import references

    rows = [
        (1, 0, "Alice joined Orbit yesterday."), (1, 1, "She reviewed it."), (1, 2, None), (1, 3, ""), (1, 4, "The New York office heard it."),
        (1, 5, "Bob Lee's plan: he and Alice met."), (1, 6, "They left."), (2, 0, "he said it."), (2, 1, "Ändern hilft, it is so"),
        (None, 0, "Carol sings, she does"), (3, None, "Dan sings, he does"), (4, 0, "The customer called."),
    ]
    got = _refs(spark, rows, user_name="Riley", things=["orbit"])
    assert got == [
        (1, 1, "it", "Orbit"), (1, 1, "she", "Alice"), (1, 4, "it", "new york"), (1, 5, "he", "Alice"), (1, 6, "they", "Alice"),
        (4, 0, "the customer", "Riley"),
    ]
    found = references.referents(spark.createDataFrame([], "g long, p long, text string"), "g", "p")
    assert found.isEmpty() and references.resolved(found, "g", "p").isEmpty()


def test_pronouns_over_slices(spark):
    """A group longer than one slice keeps its names, and the newest one wins."""
    rows = [(1, 0, "Alice came."), (1, 5000, "she left."), (1, 5001, "Bea came."), (1, 9000, "she left. Cleo stayed"), (1, 9001, "she slept")]
    assert _refs(spark, rows) == [(1, 5000, "she", "Alice"), (1, 9000, "she", "Cleo"), (1, 9001, "she", "Cleo")]


def test_redaction_reads_a_text_once_per_type(spark):
    rows = [(1, "mail a.b@c.org or 555-123-4567, card 4111 1111 1111 1111, SSN 123-45-6789, 12 Oak Street"), (2, None), (3, ""), (4, "plain")]
    df = spark.createDataFrame(rows, "id long, t string").select("id", rd.redact_pii(F.col("t")).alias("r"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == len(rd.PII_PATTERNS)
    got = {r["id"]: r["r"] for r in df.collect()}
    assert got == {
        1: "mail [REDACTED-EMAIL] or [REDACTED-PHONE], card [REDACTED-CREDIT_CARD], SSN [REDACTED-SSN], [REDACTED-ADDRESS]",
        2: None, 3: "", 4: "plain",
    }
