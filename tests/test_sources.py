import pytest
from pyspark.sql import functions as F

from caseweave.operators import relational
from caseweave.operators.relational import defect_to_incident
from caseweave.sources import articles, records, tables, threads

PROLOG = '<?xml version="1.0" encoding="UTF-8"?>\n'


def record(ident, fields, extra=""):
    body = "".join(f'<Field name="{n}">{v}\n</Field>\n' for n, v in fields)
    return f'{PROLOG}<CDETS xmlns="cdetsng">\n<Defect id="{ident}">\n{body}{extra}</Defect>\n</CDETS>\n'


BASE = [("New-on", "03/01/2015 10:00:00"), ("Component", "alpha"), ("Severity", "2")]


@pytest.fixture(scope="module")
def defects(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("records")
    notes = '<Notes><Note id="n"><Field name="Note">seen again</Field><Field name="Title">t</Field></Note></Notes>'
    audit = '<AuditTrail id="a" defectID="D2"><Field name="ChangedBy">me</Field></AuditTrail>'
    (folder / "one.xml").write_text(
        record("D1", BASE + [("Closed-on", "03/02/2015 10:00:00"), ("Resolved-on", "03/05/2015 00:00:00")])
        + record("D2", BASE + [("Closed-on", ""), ("Resolved-on", "03/03/2015 10:00:00"), ("Severity", "high"), ("Keyword", "a"), ("Keyword", "b"), ("Keyword", "a"), ("Description", "text of D2")], audit + notes)
    )
    (folder / "two.xml").write_text(
        record("D3", [("New-on", "no date"), ("Component", "beta"), ("Component", "alpha"), ("Severity", "3"), ("Severity", "1")])
        + "<CDETS><Defect id='D4'><Field name='x'>cut off"
    )
    return records.read_delimited_records(spark, str(folder))


def test_records_and_malformed(defects):
    assert defects.count() == 4
    assert sorted(r.defect_id for r in records.parse_defects(defects).collect()) == ["D1", "D2", "D3"]


def test_a_record_is_parsed_once(spark, defects):
    """Filters on a parsed record stay above it; below, each would parse the record again."""
    for df in (records.parse_defects(defects), records.defect_posts(defects)):
        plan = df._jdf.queryExecution().optimizedPlan()
        assert plan.toString().count("from_xml(") == 1


def test_metadata_holds_all_fields(defects):
    meta = {r.defect_id: r.metadata for r in records.parse_defects(defects).collect()}
    assert meta["D2"]["Keyword"] == ["a", "b"] and meta["D2"]["ChangedBy"] == ["me"] and meta["D2"]["Note"] == ["seen again"]


def test_incidents_of_records(defects):
    rows = {r.incident_id: r for r in defect_to_incident(records.parse_defects(defects)).collect()}
    assert str(rows["D1"].to_ts) == "2015-03-02 10:00:00"
    assert str(rows["D2"].to_ts) == "2015-03-03 10:00:00" and rows["D2"].severity == 2
    assert rows["D3"].from_ts is None and rows["D3"].to_ts is None and rows["D3"].severity == 1 and rows["D3"].app_name == "alpha"
    default = defect_to_incident(records.parse_defects(defects), default_severity=1000)
    assert {r.severity for r in default.collect()} == {1, 2}


def test_posts_audit_and_direct_fields(defects):
    posts = {r.post_id: r for r in records.defect_posts(defects).collect()}
    assert posts["D2"].text == "text of D2" and [c.text for c in posts["D2"].comments] == ["seen again"] and posts["D1"].comments == []
    assert [(r.defect_id, r.audit_id, r.fields) for r in records.defect_audit_rows(defects).collect()] == [("D2", "a", {"ChangedBy": "me"})]
    direct = {r.defect_id: r.Keyword for r in records.defect_direct_fields(defects, ["Keyword"]).collect()}
    assert direct == {"D1": None, "D2": "a", "D3": None}


THREAD = """
Title:
A title

URL:
http://forum.example/1

Statistics: Replies: 2   Avg. Rating: {rating} Views: 12   Votes: 1 Shares: 0

Description: b.smith... / Aug 2nd, 2005
opening text 3 votes

Reply: other / Wed, 10/10/2001 - 09:58
first answer

Reply: b.smith... / Thu, 10/11/2001 - 00:01
second answer
"""


def test_threads(spark, tmp_path):
    (tmp_path / "1234567_html.txt").write_text(THREAD.format(rating="4.5"))
    (tmp_path / "1234568_html.txt").write_text(THREAD.format(rating=""))
    (tmp_path / "1234569_html.txt").write_text("\nTitle:\nonly a title\n")
    posts = {r.post_id: r for r in threads.forum_posts(spark, str(tmp_path)).collect()}
    assert sorted(posts) == ["1234567", "1234568"]
    post = posts["1234567"]
    assert (post.title, post.author, post.text, post.rating, post.views) == ("A title", "b.smith...", "opening text", 4.5, 12)
    assert str(post.posted_at) == "2005-08-02 00:00:00" and posts["1234568"].rating is None
    assert [(c.author, str(c.date), c.text) for c in post.comments] == [
        ("other", "2001-10-10 09:58:00", "first answer"), ("b.smith...", "2001-10-11 00:01:00", "second answer"),
    ]
    rows = {r.post_id: r for r in threads.forum_posts_positional(spark, str(tmp_path)).collect()}
    assert rows["1234567"].title == "A title" and rows["1234569"].url is None


def test_long_thread_in_a_bundle(spark, tmp_path):
    turns = spark.range(2500).select(F.lit(3).alias("conv_id"), F.col("id").alias("turn"), F.concat(F.lit("text "), "id").alias("text"))
    groups = relational.collect_groups(turns, "conv_id", "turn", "text")
    assert groups.count() == 2500 and groups.where("text <> concat('text ', position)").isEmpty()
    joined = relational.joined_groups(groups.withColumn("text", F.concat(F.lit("\nReply: a / Wed, 10/10/2001 - 09:58\n"), "text")), "conv_id", "text").first()
    assert joined.n == 2500
    (tmp_path / "bundle.txt").write_text(
        "==> x/1234567_html.txt <==\n" + THREAD.format(rating="4.5") + "==> 7654321_html.txt <==\n\nDescription: a / Aug 2nd, 2005\nopening\n" + joined.text
    )
    posts = {r.post_id: r for r in threads.forum_posts(spark, str(tmp_path), bundled=True).collect()}
    assert posts["1234567"].title == "A title" and len(posts["1234567"].comments) == 2
    assert [c.text for c in posts["7654321"].comments] == [f"text {k}" for k in range(2500)]
    texts = relational.all_texts(threads.forum_posts(spark, str(tmp_path), bundled=True)).where("post_id = '7654321'")
    assert texts.count() == 2501 and texts.select("position").distinct().count() == 2501


def test_articles(spark, tmp_path):
    tree = lambda i, text: f'{PROLOG}<a xmlns="cdetsng"><techZoneContent id="{i}"><content>{text}</content></techZoneContent></a>\n'
    (tmp_path / "a.xml").write_text("stray line\n" + tree("1", "first &amp; more") + tree("2", "") + tree("3", "x" * 50))
    got = {r.post_id: r.text for r in articles.techzone_posts(spark, str(tmp_path), max_chars=10).collect()}
    assert got["1"] == "first & mo" and got["3"] == "x" * 10


def test_qa_and_wiki(spark, tmp_path):
    (tmp_path / "q" / "x.com").mkdir(parents=True)
    (tmp_path / "q" / "x.com" / "Posts.xml").write_text(
        '<?xml version="1.0"?>\n<posts>\n  <row Id="1" Body="&lt;p&gt;a &lt;b&gt;b&lt;/b&gt;&lt;/p&gt;" Tags="&lt;t1&gt;&lt;t2&gt;" />\n  <row Id="2" Body="plain/>x" />\n</posts>\n'
    )
    rows = {r.post_id: r for r in articles.qa_dump_posts(spark, str(tmp_path / "q")).collect()}
    assert rows["1"].text == "a b" and rows["1"].tags == ["<t1>", "<t2>"] and rows["1"].source == "x.com"
    assert rows["2"].tags == [] and rows["2"].text == "plain/>x"
    page = lambda title, ns, text: f"<page><title>{title}</title><ns>{ns}</ns><revision><text>{text}</text></revision></page>\n"
    (tmp_path / "w.xml").write_text(
        "<mediawiki>" + page("A", 0, "text") + page("B", 0, "#redirect [[A]]") + page("C (disambiguation)", 0, "t") + page("D", 4, "t") + page("E", 0, "") + "</mediawiki>"
    )
    assert [tuple(r) for r in articles.wiki_pages(spark, str(tmp_path / "w.xml")).collect()] == [("A", "text")]


def test_word_list_and_file_size(spark, tmp_path):
    (tmp_path / "l.txt").write_text("; note\nGood\n\nbad\ngood\n")
    assert sorted(r.word for r in tables.load_word_list(spark, str(tmp_path / "l.txt")).collect()) == ["bad", "good"]
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "small.txt").write_text("x")
    (tmp_path / "d" / "large.txt").write_text("y" * 2000)
    kept = tables.filter_by_size(spark.read.text(str(tmp_path / "d"), wholetext=True))
    assert [r.value[0] for r in kept.collect()] == ["y"]
