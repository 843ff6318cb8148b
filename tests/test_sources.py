from pyspark.sql import functions as F

from glossmill.sources import backup, delimited, dictionary, exports, feeds, files, mailbox
from glossmill.streaming.ingest import deduplicated, ingest_messages, windowed_counts


def test_delimited_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a:b", "c!d"), ("", "x")], "p string, q string")
    delimited.write_delimited(df, str(tmp_path / "t"))
    assert sorted(map(tuple, delimited.read_delimited(spark, str(tmp_path / "t"), ["p", "q"]).collect())) == [("", "x"), ("a:b", "c!d")]
    (tmp_path / "seeds").write_text("# note\nhttp://a.org/\n! b.org/x\n\n")
    assert sorted(tuple(r) for r in delimited.read_seeds(spark, str(tmp_path / "seeds")).collect()) == [("a.org", "New", 5000.0), ("b.org/x", "Skip", 5000.0)]


def test_backup_and_restore(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", b"x"), (2, "b", b"y")], "k int, v string, blob binary")
    manifest = backup.backup({"t": df}, str(tmp_path / "b"))
    assert tuple(manifest.first()) == ("t", ["k", "v"], 2)
    held = spark.createDataFrame([(2, "old"), (3, "c")], "k int, v string")
    got = backup.restore(spark, str(tmp_path / "b"), into={"t": held}, keys={"t": ["k"]})["t"]
    assert sorted(tuple(r) for r in got.collect()) == [(1, "a"), (2, "b"), (3, "c")]


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_text("plain text")
    (tmp_path / "sub" / "b.html").write_text("<p>Some <b>bold</b></p><script>x</script>")
    (tmp_path / "sub" / "my_song.mp3").write_bytes(b"\x00")
    found = files.scan_folder(spark, str(tmp_path))
    texts = {r.path.rsplit("/", 1)[1]: r.text for r in files.file_texts(found).collect()}
    assert texts["a.txt"] == "plain text" and texts["b.html"] == "Some bold" and texts["my_song.mp3"].endswith("my song")
    assert files.scan_folder(spark, str(tmp_path), found.select("path")).count() == 0


def test_mailbox(spark):
    raw = "From: Jo <jo@x.org>\nTo: bo@y.org\nDate: 4 Mar 2003 10:20:30\nSubject: hello  there\n\nBody one\n\nmore\n--- end of message ---\nFrom: al@x.org\nTo: bo@y.org\nSent: March 5, 2003 1:00 PM\n\nTwo\n-- End of message\n"
    got = mailbox.parse_messages(spark.createDataFrame([("f", raw)], "source string, value string")).orderBy("number").collect()
    assert [(r.sender, r.subject, str(r["at"])) for r in got] == [("Jo <jo@x.org>", "hello there", "2003-03-04 10:20:30"), ("al@x.org", None, "2003-03-05 13:00:00")]
    assert got[0].text.startswith("Body one\n\nmore")


def test_feeds_and_networks(spark, tmp_path):
    xml = "<rss><item><title>A</title><link>http://a.org/1</link><description><![CDATA[Text <b>]]></description></item><item><title>no link</title></item></rss>"
    assert [tuple(r) for r in feeds.feed_items(spark.createDataFrame([("s", xml)], "source string, xml string")).collect()] == [("s", "http://a.org/1", "A", "Text <b>")]
    sgml = "<REUTERS id=1><TOPICS><D>grain</D></TOPICS><PLACES><D>usa</D><D>uk</D></PLACES><BODY>" + "x" * 1000 + "</BODY></REUTERS>"
    got = feeds.tagged_stories(spark.createDataFrame([("s", sgml)], "source string, value string")).first()
    assert got.topics == ["grain"] and got.places == ["usa", "uk"] and len(got.body) == 1000
    edges = spark.createDataFrame([("B@x", "a@x", 2), ("a@x", "c@x", 1)], "source string, target string, n long")
    lines = [r.line for r in exports.network_lines(edges).orderBy("section", "key").collect()]
    assert lines == ["*Vertices 3", '1 "a"', '2 "b"', '3 "c"', "*Arcs", "1 3 1", "2 1 2"]


def test_dictionary_files(spark):
    lines = ["  1 licence", "00000001 05 n 02 big_cat 0 Lion 0 001 @ 00000002 n 0000 | a cat", "00000002 05 n 01 animal 0 000 | a being"]
    tables = dictionary.dictionary_tables(dictionary.data_lines(spark.createDataFrame([(x,) for x in lines], "value string")))
    assert sorted((r.word, r.synset, r.is_entity) for r in tables["words"].collect()) == [("animal", "n00000002", False), ("big_cat", "n00000001", False), ("lion", "n00000001", True)]
    assert [tuple(r) for r in tables["relations"].collect()] == [("hypernym", "n00000001", "n00000002")]
    marked = dictionary.marked_entities(spark.createDataFrame([(1, "in <PLACE>Rome</PLACE> today."), (2, "# note")], "doc_id int, value string")).orderBy("pos").collect()
    assert [(r.token, r.type) for r in marked] == [("in", None), ("Rome", "place"), ("today", None), (".", None)]
    tagged = dictionary.tagged_words(spark.createDataFrame([(1, "birds <n> fly <v>")], "doc_id int, value string")).collect()
    assert [(r.word, r.tag) for r in tagged] == [("birds", "n"), ("fly", "v")]


def test_streaming_ingest(spark, tmp_path):
    schema = "id int, at timestamp, sender string, recipient string, subject string, text string"
    batch = spark.createDataFrame([(1, "a@x.org", "b@x.org", "budget", "budget numbers"), (2, "a@x.org", "b@x.org", "budget", "budget numbers")], "id int, sender string, recipient string, subject string, text string").withColumn("at", F.lit("2024-01-01").cast("timestamp"))
    batch.select("id", "at", "sender", "recipient", "subject", "text").write.parquet(str(tmp_path / "in"))
    centres = spark.createDataFrame([("money", "budget", 1.0)], "category string, term string, weight double")
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    ingest_messages(stream, centres, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out" / "messages")).collect()
    assert [(r.id, r.category) for r in got] == [(1, "money")]
    assert spark.read.parquet(str(tmp_path / "out" / "postings")).filter("term = 'budget'").count() == 1
    assert windowed_counts(batch, "at", "sender", "1 hour").first().n == 2
    assert deduplicated(stream.withColumn("digest", F.md5("text"))).isStreaming
