"""Operators on small hand-made tables: damage, ties, empty input, and what driver tables don't contain."""

import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from codexspark.functions import binary as B
from codexspark.functions import text as T
from codexspark.operators import dictionary, edits, markup, metadata, navigation, predicates, resources, rewrite, text
from codexspark.plans.reconstruct import Collection
from codexspark.sources import containers as C
from codexspark.sources import fixtures, reader, writer
from codexspark.sources.files import read_headers, write_files, write_joined
from codexspark.sources.staging import staged
from codexspark.streaming import arrivals


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_numbers(spark):
    one = spark.createDataFrame([(bytearray(b"\xff\xff\xff\xff\x01"),)], "d binary")
    got = one.select(B.u32(F.col("d"), 0), B.u32(F.col("d"), 2), B.u16(F.col("d"), 3), B.le32(F.col("d"), 1), B.first_value(F.lit(b"")), B.base32(F.lit("VVVVVV")), B.base32(F.lit("1VVVVVV")), B.base32(F.lit("v")), B.base32(F.lit("000"))).first()
    assert list(got) == [0xFFFFFFFF, None, 0xFF01, 0x01FFFFFF, 0, 1073741823, None, None, 0]


def test_times(spark):
    seen = spark.range(1).select(*[F.date_format(B.container_time(F.lit(v).cast("long")), "yyyy-MM-dd") for v in (1 << 31, 86400, 0, 1)]).first()
    assert list(seen) == ["1972-01-19", "1970-01-02", "1970-01-01", "1970-07-14"]


def test_backward_varlen(spark):
    data = spark.createDataFrame([(bytearray(b"xx\x82\x01"),), (bytearray(b"\x82"),)], "d binary")
    rows = data.select(B.varlen(F.col("d"), F.length("d"), forward=False).alias("v")).select("v.value", "v.size").collect()
    assert tuple(rows[0]) == (0x101, 2)
    assert rows[1]["size"] == 0  # byte 0 is never taken


def test_charsets_and_entities(spark):
    rows = spark.createDataFrame([(bytearray(b"\x80uro\x81\x00rest"), 1252), (bytearray("€".encode()), 65001), (bytearray(b"\xff"), 65001), (None, 1252)], "d binary, c int")
    assert [r[0] for r in rows.select(T.decode_text("d", "c")).collect()] == ["€uro�", "€", "�", None]
    text_ = spark.createDataFrame([("&amp;lt; &#65;&#x42;&nope;&#0;&#xD800;",), (None,)], "t string")
    assert [r[0] for r in text_.select(T.decode_entities(F.col("t"))).collect()] == ["&lt; AB&nope;&#0;&#xD800;", None]


@pytest.mark.parametrize("compression", [1, 2, 17480])
def test_text_is_the_same_in_every_container(spark, compression):
    texts = ["", "short", "äöü€" * 3000, None, "\0zero\0", "long " * 5000]
    recs = C.records(fixtures.containers(docs(spark, *texts), compression))
    got = {r.doc_id: bytes(r.text).decode() for r in text.rawml(recs, C.headers(recs)).collect()}
    assert got == {i: t or "" for i, t in enumerate(texts)}


def test_every_truncation_gets_a_status(spark):
    file = fixtures.containers(docs(spark, "text"), 2, tags=F.array(fixtures.tag(100, F.lit("me")))).first().content
    cuts = spark.createDataFrame([(i, bytearray(file[:i])) for i in range(0, len(file), 7)], "doc_id long, content binary")
    assert all(r.status for r in C.pdb_headers(cuts).collect())
    recs = C.records(cuts)
    heads = C.headers(recs)
    C.exth(heads).collect()
    assert {r.status for r in text.rawml(recs, heads).collect()} <= {"SUCCESS", "DATA_CORRUPT"}


def test_one_bad_record_fails_its_document_only(spark):
    recs = fixtures.records(docs(spark, "good", "bad"), 2).select("doc_id", "seq", "data")
    recs = recs.withColumn("data", F.when((F.col("doc_id") == 1) & (F.col("seq") == 1), F.lit(b"\x80")).otherwise(F.col("data")))
    got = {r.doc_id: r.status for r in text.rawml(recs, C.headers(recs)).collect()}
    assert got == {0: "SUCCESS", 1: "DATA_CORRUPT"}


def test_trailing_entries_are_cut(spark):
    recs = fixtures.records(docs(spark, "text"), 1, values={"extra_flags": F.lit(3)}).select("doc_id", "seq", "data")
    recs = recs.withColumn("data", F.when(F.col("seq") == 1, F.concat("data", F.lit(b"\x00xx\x83"))).otherwise(F.col("data")))
    assert bytes(text.rawml(recs, C.headers(recs)).first().text) == b"text"


def test_metadata_edits(spark):
    tags = spark.createDataFrame([(1, 0, 100, bytearray(b"a")), (1, 1, 105, bytearray(b"s")), (2, 0, 100, bytearray(b"b"))], "doc_id long, ord int, tag int, data binary")
    steps = spark.createDataFrame([(1, 1, "add", 105, bytearray(b"t")), (1, 2, "delete", 100, bytearray()), (1, 3, "add", 100, bytearray(b"n")), (1, 4, "add", 101, bytearray())], "doc_id long, step int, action string, tag int, data binary")
    got = sorted((r.doc_id, r.tag, r.ord, bytes(r.data)) for r in metadata.apply_actions(tags, steps).collect())
    assert [(d, t, v) for d, t, _, v in got] == [(1, 100, b"n"), (1, 105, b"s"), (1, 105, b"t"), (2, 100, b"b")]
    assert metadata.delete_tags(tags, steps.limit(0)).count() == 3
    assert metadata.add_tags(tags.limit(0), tags).count() == 3


def test_locales(spark):
    rows = spark.createDataFrame([(9,), (9 + 0x0800,), (9 + 0xFC00,), (255,), (None,)], "locale_no long")
    assert sorted(str(r.locale) for r in metadata.with_locale(rows).collect()) == ["None", "None", "None", "en", "en-gb"]  # a region without a name has none
    names = spark.createDataFrame([("EN-gb",), ("en-zz",), ("xx",), (None,)], "locale string")
    assert {r.locale: r.locale_no for r in metadata.with_locale_number(names).collect()} == {"EN-gb": 9 + 0x0800, "en-zz": 9, "xx": 0, None: 0}
    table = metadata.locale_table(spark)
    assert table.count() == table.select("language_no", "region_no").distinct().count() == len(metadata.LANGUAGES) + sum(map(len, metadata.REGIONS.values()))


def test_resources_stop_and_count(spark):
    rows = [(1, i, bytearray(d)) for i, d in enumerate((b"\xff\xd8\xff", b"junk", b"FONTbad", b"GIF8", b"BOUNDARY", b"GIF8"))]
    recs = spark.createDataFrame(rows, "doc_id long, seq int, data binary")
    first = spark.createDataFrame([(1, 0)], "doc_id long, first long")
    assert sorted((r.uid, r.kind) for r in resources.resources(recs, first).collect()) == [(0, "JPG"), (3, "GIF")]
    bmp = spark.createDataFrame([(bytearray(b"BM\x06\x00\x00\x00"),), (bytearray(b"BM\x07\x00\x00\x00"),)], "d binary")
    assert [r[0] for r in bmp.select(resources.magic(F.col("d"))).collect()] == ["BMP", "UNKNOWN"]


def test_fragments_go_in_one_after_the_other(spark):
    raw = spark.createDataFrame([(1, bytearray(b"<a></a>XYZshort"))], "doc_id long, text binary")
    skeletons = spark.createDataFrame([(1, 0, 0, 7, 2), (1, 1, 10, 99, 0)], "doc_id long, entry_no int, position long, length long, n_fragments int")
    fragments = spark.createDataFrame([(1, 0, 3, 0, 1), (1, 1, 99, 0, 2)], "doc_id long, entry_no int, insert_at long, file_nr long, length long")
    got = {r.uid: (r.status, r.data and bytes(r.data)) for r in markup.markup_parts(raw, skeletons, fragments).collect()}
    assert got == {0: ("SUCCESS", b"<a>X</a>YZ"), 1: ("DATA_CORRUPT", None)}


def test_next_anchor(spark):
    targets = spark.createDataFrame([(1, 5), (1, 6), (1, 99), (2, 0)], "doc_id long, at long")
    anchors = spark.createDataFrame([(1, 5, "a"), (1, 8, "b")], "doc_id long, at long, value string")
    got = {(r.doc_id, r["at"]): r.anchor for r in markup.next_anchors(targets, anchors, ["doc_id"]).collect()}
    assert got == {(1, 5): "a", (1, 6): "b", (1, 99): None, (2, 0): None}


def test_links_in_style_sheets_and_flow_kinds(spark):
    css = spark.createDataFrame([(1, 0, bytearray(b"p{background:url('kindle:embed:0001?mime=image/png')} kindle:embed:0002"))], "doc_id long, uid int, data binary")
    links = markup.kindle_links(css, style=True).collect()
    assert [(r.kind, r.fid) for r in links] == [("embed", 1)]
    assert bytes(css.first().data)[links[0].start : links[0].stop] == b"kindle:embed:0001?mime=image/png"
    flows = spark.createDataFrame([(1, 0, bytearray(b'<link href="kindle:flow:000A?mime=text/css"/>')), (1, 10, bytearray(b"p{}")), (1, 2, bytearray(b""))], "doc_id long, uid int, data binary")
    assert {r.uid: r.kind for r in markup.flow_kinds(flows).collect()} == {0: "HTML", 10: "CSS", 2: "UNKNOWN"}


def test_broken_trees_end(spark):
    rows = spark.createDataFrame([(1, 0, "a", "t", 0, None, 1, 1), (1, 1, "b", "t", 1, 0, None, None), (1, 2, "c", "t", 1, 3, None, None), (1, 3, "d", "t", 1, 2, None, None)], "doc_id long, entry_no int, title string, target string, level int, parent long, child_start long, child_end long")
    assert [r.id for r in navigation.toc_tree(rows).orderBy("play_order").collect()] == ["toc-1", "toc-1-1"]
    assert navigation.toc_tree(rows.limit(0)).count() == 0


def test_package_without_contents_keeps_its_parts(spark):
    meta = spark.createDataFrame([(1, "dc", "title", 0, None, "a<b")], "doc_id long, grp string, element string, ord int, attribute string, value string")
    items = spark.createDataFrame([(1, 0, "part00000", "part00000.html", "application/xhtml+xml")], "doc_id long, place long, id string, href string, media_type string")
    none = spark.createDataFrame([], "doc_id long, ord int, type string, title string, href string")
    got = navigation.package_xml(meta, items, none).first()
    assert got.status == "NCX_MISSING" and "<dc:title>a&lt;b</dc:title>" in got.xml and "part00000.html" in got.xml


def test_suffixes(spark):
    words = spark.createDataFrame([("city",), ("a",), ("",)], "word string")
    endings = spark.createDataFrame([("y", "ies"), ("", "!"), ("city", "x")], "base string, ending string")
    got = sorted((r.word, r.form) for r in dictionary.suffix_forms(words, endings, []).collect())
    assert got == [("", "!"), ("a", "a!"), ("city", "cities"), ("city", "city!"), ("city", "x")]


def test_suffixes_from_a_pool(spark):
    """Shortest base first, entries in order; bases that are empty, cut or beyond the pool are left out; bytes, no charset."""
    tags = "array<struct<tagid:int,values:array<bigint>>>"
    infl = [(1, 0, b"x\xe9", [(7, [1, 1, 2, 0])]), (1, 1, b"z", [(7, [0, 0, 9, 9, 1, 1, 5])]), (1, 2, b"n", []), (2, 0, b"q", [(7, [1, 1])])]
    infl = spark.createDataFrame([(d, e, bytearray(w), t) for d, e, w, t in infl], f"doc_id long, entry_no int, label binary, tags {tags}")
    orth = [(1, 0, b"ab", []), (1, 1, b"", []), (2, 0, b"ab", [(42, [0])]), (3, 0, b"ab", [])]
    orth = spark.createDataFrame([(d, e, bytearray(w), t) for d, e, w, t in orth], f"doc_id long, entry_no int, label binary, tags {tags}")
    pool = spark.createDataFrame([(1, bytearray(b"ab")), (2, bytearray(b"ab"))], "doc_id long, pool binary")
    got = dictionary.pool_forms(orth, infl, pool).selectExpr("doc_id", "entry_no", "ord", "hex(cast(form as binary)) as form", "name").collect()
    assert sorted(tuple(r) for r in got) == [(1, 0, 1, "6178E9", None), (1, 0, 2, "617A", None), (1, 0, 3, "78E9", None)]
    assert dictionary.pool_forms(orth.limit(0), infl, pool).count() == 0 == dictionary.pool_forms(orth, infl.limit(0), pool).count()


def test_headwords_keep_their_bytes(spark):
    """A headword in a one-byte charset passes rules and markup unchanged."""
    tags = "array<struct<tagid:int,values:array<bigint>>>"
    orth = spark.createDataFrame([(1, 0, bytearray(b"caf\xe9"), [(42, [0])], 0, 0)], f"doc_id long, entry_no int, label binary, tags {tags}, position long, length long")
    infl = spark.createDataFrame([(1, 0, bytearray(b"g"), [(5, [0]), (26, [1])]), (1, 1, bytearray(b"\x02s"), [])], f"doc_id long, entry_no int, label binary, tags {tags}")
    got = dictionary.headword_inserts(orth, dictionary.rule_forms(orth, infl)).collect()
    assert [bytes(r.value) for r in got] == [b'<idx:entry><idx:orth value="caf\xe9"><idx:infl><idx:iform value="caf\xe9s"/></idx:infl></idx:orth></idx:entry>']


def test_record_ranges(spark):
    recs = spark.createDataFrame([(1, i, bytearray(b"%d" % i)) for i in range(5)], "doc_id long, seq int, data binary")
    span = spark.createDataFrame([(1, 1, 2)], "doc_id long, first int, count int")
    seen = lambda rows: [(r.seq, bytes(r.data)) for r in rows.orderBy("seq").collect()]
    assert seen(edits.extracted(recs, span)) == [(0, b"1"), (1, b"2")]
    assert seen(edits.deleted(recs, span)) == [(0, b"0"), (1, b"3"), (2, b"4")]
    new = spark.createDataFrame([(1, 0, bytearray(b"a")), (1, 1, bytearray(b"b"))], "doc_id long, seq int, data binary")
    assert [d for _, d in seen(edits.inserted(recs, new, spark.createDataFrame([(1, 1)], "doc_id long, at int")))] == [b"0", b"a", b"b", b"1", b"2", b"3", b"4"]
    assert [d for _, d in seen(edits.inserted(recs, new, spark.createDataFrame([], "doc_id long, at int")))][-2:] == [b"a", b"b"]


def test_versions(spark):
    rows = spark.createDataFrame([(False, 0, None), (True, 0x10, 6), (True, 0x60, 3), (True, 0xE4, 6), (True, 0xE3, 6), (True, 0x74, 1)], "has boolean, n long, v long")
    assert [r[0] for r in rows.select(predicates.file_version("has", "n", "v")).collect()] == [1, 2, 0xFFFFFFFF, 6, 0xFFFFFFFF, 1]


def test_files_and_stream(spark, tmp_path):
    files = fixtures.containers(docs(spark, "one", "two"), 2)
    named = files.select(F.concat("doc_id", F.lit(".mobi")).alias("file_name"), F.col("content").alias("data"))
    assert write_files(named, str(tmp_path / "in"))[0] == 2
    scanned = C.scan(spark, str(tmp_path / "in"), "*.mobi")
    assert sorted(bytes(r.text) for r in Collection(scanned.select("doc_id", "content")).text.collect()) == [b"one", b"two"]
    stream = arrivals.arriving(spark, str(tmp_path / "in"), "*.mobi", per_batch=1)
    arrivals.written(stream, lambda b: Collection(b.select("doc_id", "content")).pdb.select("doc_id", "status"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_whole_book(spark):
    """An older document with an image and a link, rebuilt into its files."""
    body = '<html><body><p>one</p><a filepos=12>go</a><img recindex="00001"/></body></html>'
    recs = fixtures.records(docs(spark, body), 2, tags=F.array(fixtures.tag(503, F.lit("Title & more"))))
    recs = recs.select("doc_id", "seq", "data").unionByName(spark.createDataFrame([(0, 2, bytearray(b"\xff\xd8\xffimage"))], "doc_id long, seq int, data binary"))
    book = Collection(writer.assembled(recs, docs(spark, "x").select("doc_id", F.lit("book").alias("name"))))
    files = {r.file_name: bytes(r.data) for r in book.file_table.collect()}
    assert set(files) == {"part00000.html", "resource00000.jpg", "resource00001.ncx", "content.opf"}
    assert files["part00000.html"] == b'<html><body><a id="0000000012"></a><p>one</p><a href="#0000000012">go</a><img src="resource00000.jpg"/></body></html>'
    assert b"<dc:title>Title &amp; more</dc:title>" in files["content.opf"] and b'<spine toc="resource00001">' in files["content.opf"]


def test_archives_are_made_of_members(spark, tmp_path):
    """Archives of several documents: sound, equal to their files, and the same whether kept as a value or written in parts."""
    rng = random.Random(3)
    rows = [(d, n, bytearray(rng.randbytes(size) + b"a" * size)) for d in (7, 8) for n, size in (("content.opf", 50), ("part00000.html", 70_000), ("resource00000.jpg", 0), ("größe.html", 9))]
    members = resources.archive_members(spark.createDataFrame(rows, "doc_id long, file_name string, data binary").repartition(3))
    parts = resources.archive_parts(staged(members, "members"))
    books = {r.doc_id: bytes(r.epub) for r in resources.epub(parts).collect()}
    assert set(books) == {7, 8}
    for d, book in books.items():
        with zipfile.ZipFile(io.BytesIO(book)) as z:
            assert z.testzip() is None
            assert z.namelist() == ["mimetype", "META-INF/container.xml", "OEBPS/content.opf", "OEBPS/größe.html", "OEBPS/part00000.html", "OEBPS/resource00000.jpg"]
            assert {n: z.read(f"OEBPS/{n}") for o, n, _ in rows if o == d} == {n: bytes(x) for o, n, x in rows if o == d}
        assert book[38:58] == b"application/epub+zip"
    n, size = write_joined(parts.select(F.concat(F.col("doc_id").cast("string"), F.lit(".epub")).alias("file_name"), "place", "data"), str(tmp_path / "out"))
    assert (n, size) == (2, sum(map(len, books.values())))
    assert {d: (tmp_path / "out" / f"{d}.epub").read_bytes() for d in books} == books
    assert resources.epub(resources.archive_parts(members.limit(0))).count() == 0


def test_archives_of_more_members_than_two_bytes_count():
    body, entries = bytearray(), bytearray()
    for i in range(70_000):
        name = b"%05d" % i
        entries += resources.central_part(name, 0, 0, 0, len(body), 0)
        body += resources.local_part(name, 0, 0, 0, 0)
    assert len(entries) == 70_000 * 51
    with zipfile.ZipFile(io.BytesIO(body + entries + resources.directory_end(70_000, len(entries), len(body)))) as z:
        assert len(z.namelist()) == 70_000 and z.read("69999") == b""
    far = resources.central_part(b"x", 0, 0, 0, 1 << 33)
    assert far.endswith(b"x" + b"\1\0\x08\0" + (1 << 33).to_bytes(8, "little")) and far[42:46] == b"\xff" * 4


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    """A task that fails takes the whole job's files with it; what an earlier job wrote stays."""
    good = spark.createDataFrame([("a.bin", bytearray(b"one")), ("../b.bin", bytearray(b"two"))], "file_name string, data binary")
    assert write_files(good.repartition(2), str(tmp_path / "out")) == (2, 6)
    assert (tmp_path / "out" / "b.bin").read_bytes() == b"two" and not (tmp_path / "b.bin").exists()
    bad = spark.range(0, 40, 1, 4).select(F.concat(F.col("id").cast("string"), F.lit(".bin")).alias("file_name"), F.when(F.col("id") < 39, F.lit(b"x")).otherwise(F.raise_error(F.lit("broken")).cast("binary")).alias("data"))
    with pytest.raises(Exception, match="broken"):
        write_files(bad, str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["_committed.json", "a.bin", "b.bin"]
    assert write_files(good, str(tmp_path / "out")) == (2, 6)  # again: nothing is doubled
    assert sorted(p.name for p in (tmp_path / "out").glob("*.bin")) == ["a.bin", "b.bin"]


def test_headers_are_read_by_seeks(spark, tmp_path):
    files = fixtures.containers(docs(spark, "one", "two " * 50_000), 1)
    write_files(files.select(F.concat("doc_id", F.lit(".mobi")).alias("file_name"), F.col("content").alias("data")), str(tmp_path / "in"))
    (tmp_path / "in" / "short.mobi").write_bytes(b"too short")
    (tmp_path / "in" / "other.txt").write_bytes(b"x" * 200)
    rows = {r.path.rsplit("/")[-1]: r for r in read_headers(spark, str(tmp_path / "in"), "*.mobi").collect()}
    assert set(rows) == {"0.mobi", "1.mobi", "short.mobi"} and rows["short.mobi"].head is None
    assert rows["1.mobi"].length > 200_000 and rows["1.mobi"].bytes_read < 2000
    whole = (tmp_path / "in" / "1.mobi").read_bytes()
    assert whole.startswith(rows["1.mobi"].head + rows["1.mobi"].directory) and rows["1.mobi"].record0 in whole
    assert {r.bytes_read for r in read_headers(spark, str(tmp_path / "in"), "*.mobi", "path string, head binary, bytes_read long").collect()} == {0, 78}
    assert read_headers(spark, str(tmp_path / "in"), "none").count() == 0


def test_trees_of_any_depth_and_damage(spark):
    tree_of = lambda rows: [(w["i"], w["depth"], w["path"]) for w in navigation.walked([dict(zip(("entry_no", "level", "parent", "child_start", "child_end", "there"), (*r, True))) for r in rows])]
    deep = [(i, i, i - 1 if i else None, i + 1 if i < 999 else None, i + 1 if i < 999 else None) for i in range(1000)]
    got = tree_of(deep)
    assert [d for _, d, _ in got] == list(range(1, 1001)) and got[-1][2] == (1,) * 1000
    assert tree_of([(0, 0, None, None, None), (1, 0, 0, None, None)]) == [(0, 1, (1,)), (1, 1, (1, 2))]  # by its own level, whatever its parent
    assert tree_of([(0, 0, None, 1, 2), (1, 1, 0, None, None), (2, 2, 1, None, None)]) == [(0, 1, (1,)), (1, 2, (1, 1))]  # a level too far down
    assert tree_of([(0, 0, None, 1, 1), (1, 1, 0, 1, 1)]) == [(0, 1, (1,)), (1, 2, (1, 1))]
    assert tree_of([(0, 0, 0, None, None)]) == [(0, 1, ())]  # its own parent
    assert tree_of([(0, 0, 1, None, None), (1, 0, 0, None, None)])  # a circle ends
    assert tree_of([(0, 0, None, 5, 6)]) == [] == tree_of([(0, None, None, None, None)]) == tree_of([])
    twice = [(0, 0, None, 2, 2), (1, 0, None, 2, 2), (2, 1, 0, None, None)]
    assert [i for i, _, _ in tree_of(twice)] == [0, 2, 1]


def test_no_document_changes_another_ones_tree(spark):
    schema = "doc_id long, entry_no int, title string, target string, level int, parent long, child_start long, child_end long"
    one = [(1, 0, "a", "t", 0, None, 1, 1), (1, 1, "b", "t", 0, 0, None, None)]
    two = [(2, 0, "a", "t", 0, None, 1, 1), (2, 1, "b", "t", 1, 0, None, None)]
    seen = lambda rows: [(r.id, r.play_order) for r in navigation.toc_tree(spark.createDataFrame(rows, schema)).filter("doc_id = 1").orderBy("play_order").collect()]
    assert seen(one) == seen(one + two) == [("toc-1", 1), ("toc-1-1", 2)]


def test_payload_stays_in_its_row(spark):
    """Text, records, index entries, pools and resources of a collection plan no exchange."""
    book = Collection(staged(fixtures.containers(docs(spark, "text"), 2), "containers"))
    for rows in (book.opened, book.records, text.container_text(book.opened, F.col("base_seq")), reader.index_records(book.opened, "ncx_index"), reader.pools(book.opened, "ncx_index"), reader.sections(book.opened), reader.resources(book.files), rewrite.edited(book.files, rewrite.action("set", 100, F.lit("a")))):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Join" not in plan, plan


def test_edits_of_damaged_and_short_containers(spark):
    head = bytes(76)
    assert rewrite.with_steps(head + b"\0\1", []) is None and rewrite.with_metadata(b"", []) is None
    one = rewrite.put_together(head + b"\0\0", [(7, b"zero"), (0, b"one")])
    assert rewrite.taken_apart(one)[1] == [(7, b"zero"), (0, b"one")]
    steps = [{"action": "insert", "at": None, "count": 0, "data": [b"end"]}, {"action": "replace", "at": 0, "count": 0, "data": [b"0"]}, {"action": "delete", "at": 1, "count": 1, "data": None}, {"action": "replace", "at": 9, "count": 0, "data": [b"no"]}]
    assert rewrite.taken_apart(rewrite.with_steps(one, steps))[1] == [(7, b"0"), (0, b"end")]
    assert rewrite.with_steps(one, [{"action": "delete", "at": 0, "count": 9, "data": None}]) is None
    assert rewrite.with_metadata(one, [{"action": "set", "tag": 100, "value": "x"}]) == one  # no long header to hold it
    assert [rewrite.locale_number(n) for n in ("EN-gb", "en-zz", "xx", "de")] == [9 + 0x0800, 9, 0, 7]


def test_metadata_of_a_whole_hybrid_and_the_command_line(spark, tmp_path, capsys):
    from codexspark.__main__ import main

    files = fixtures.containers(docs(spark, "text"), 2, tags=F.array(fixtures.tag(100, F.lit("me")), fixtures.tag(105, F.lit("s"))))
    write_files(files.select(F.lit("a.mobi").alias("file_name"), F.col("content").alias("data")), str(tmp_path / "in"))
    assert main(["meta", str(tmp_path / "in"), "-a", "author=you", "-s", "title=New: one", "-d", "subject", "-a", "116=7", "-o", str(tmp_path / "out")]) == 0
    assert "1 files" in capsys.readouterr().out
    book = Collection(C.scan(spark, str(tmp_path / "out"), "*.mobi").select("doc_id", "content"))
    got = book.summary.first()
    assert (got.author, got.title, got.subject, got.name) == ("me; you", "New: one", None, "New__one")
    assert [r.value for r in book.decoded_tags.filter("tag = 116").collect()] == ["7"] and bytes(book.text.first().text) == b"text"
    book.close()
    for command in ("text", "dump", "parts"):
        assert main([command, str(tmp_path / "in"), "-o", str(tmp_path / command)]) == 0
    assert [p.read_bytes() for p in (tmp_path / "text").glob("*.rawml")] == [b"text"]
    assert len(list((tmp_path / "dump").glob("*record_*"))) == 2
    assert main(["summary", str(tmp_path / "in")]) == 0


def test_containers_are_written_in_their_row(spark, tmp_path):
    """Neither making containers nor writing them again from their records and headers shuffles; a damaged directory gives null."""
    text = "two " * 5000
    for compression in (1, 2, 17480):
        made = fixtures.containers(docs(spark, "one", text), compression)
        assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
        rows = fixtures.records(docs(spark, "one", text), compression)
        names = docs(spark, "one", text).select("doc_id", F.concat(F.lit("doc_"), F.col("doc_id")).alias("name"))
        assert sorted(made.collect()) == sorted(writer.assembled(rows, names).collect())
    files = staged(made, "containers").unionByName(spark.createDataFrame([(7, b"BOOK" * 30), (8, None)], "doc_id long, content binary"))
    again = writer.packed(files.select("doc_id", *C.pdb_columns(F.col("content")), reader.records_of(F.col("content")).alias("records")))
    assert "Exchange" not in again._jdf.queryExecution().executedPlan().toString()
    got, wanted = dict(again.collect()), dict(files.collect())
    assert got.pop(7) is None and got.pop(8) is None and got == {k: v for k, v in wanted.items() if k < 7}


def test_hybrids_are_taken_apart_in_their_row(spark):
    """Sources, fonts and the newer half go from the older one; resources move into the newer one; a start beyond its text goes."""
    number = fixtures.number_tag
    tags = [number(121, F.lit(6)), number(125, F.lit(1)), fixtures.tag(129, F.lit("kindle:cover"))]
    old = fixtures.record_array(F.lit("old"), tags=F.array(*tags), values={"srcs_index": F.lit(4), "srcs_count": F.lit(1)}, name=F.lit("Title"))
    new = fixtures.record_array(F.lit("new"), 2, tags=F.array(number(125, F.lit(1)), number(116, F.lit(9))), values={"version": F.lit(8), "fdst_index": F.lit(3)}, newer=True)
    rest = lambda *data: F.array(*[F.lit(d) for d in data])
    records = F.concat(old, rest(b"\xff\xd8\xffimage", b"FONTfont", b"SRCSzip", b"BOUNDARY"), new, rest(b"FONTown", b"\xe9\x8e\r\n"))
    files = fixtures.packed_records(docs(spark, "x"), records, F.lit("hybrid")).unionByName(fixtures.containers(docs(spark, "a", "plain")).filter("doc_id = 1"))
    files = files.unionByName(spark.createDataFrame([(2, b"short"), (3, None)], "doc_id long, content binary"))
    both = rewrite.versions(staged(files, "containers"))
    assert "Exchange" not in both._jdf.queryExecution().executedPlan().toString()
    rows = {r.doc_id: r for r in both.collect()}
    assert [rows[i].halves for i in range(4)] == [2, 1, None, None] and rows[1].older is None and rows[1].newer is None
    older, newer = (rewrite.taken_apart(bytes(x))[1] for x in (rows[0].older, rows[0].newer))
    assert [d for _, d in older[1:]] == [b"old", b"\xff\xd8\xffimage", b"FONT", b"\xe9\x8e\r\n"]
    assert rewrite.read_zero(older[0][1]) == ([(121, b"\xff\xff\xff\xff"), (125, b"\0\0\0\1")], b"Title")
    assert [reader.header_field(older[0][1], n) for n in ("srcs_index", "srcs_count", "exth_flags")] == [None, 0, 0x40]
    assert [d for _, d in newer[1:]] == [b"new", b"\xff\xd8\xffimage", b"FONTown", b"\xe9\x8e\r\n"]
    assert rewrite.read_zero(newer[0][1])[0] == [(125, b"\0\0\0\2")]
    assert [reader.header_field(newer[0][1], n) for n in ("fdst_index", "exth_flags", "image_index")] == [4, 0x840, 2]


def test_archives_come_of_small_plans(spark, monkeypatch):
    """What an archive consists of is put at rest group by group: no plan joins more than a few tables."""
    from codexspark.sources import staging

    seen, kept = {}, staging.staged

    def counted(rows, label, release=False):
        seen[label] = max(seen.get(label, 0), rows._jdf.queryExecution().optimizedPlan().toString().count("Join "))
        return kept(rows, label, release)

    monkeypatch.setattr(staging, "staged", counted)
    book = Collection(kept(fixtures.containers(docs(spark, "text"), 2), "containers"))
    names = sorted(r.name for r in book.archive_members.select("name").collect())
    assert names == ["OEBPS/content.opf", "OEBPS/part00000.html", "OEBPS/resource00000.ncx"]
    assert max(seen.values()) <= 15, seen
    book.close()
