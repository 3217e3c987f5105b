import io
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from doclake.functions import fixed as X
from doclake.plans import explorer as E, reporting as R
from doclake.sources import documents as D, ingest as I
from doclake.sources.tables import TableStore

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
REL = 'xmlns="http://schemas.openxmlformats.org/package/2006/relationships"'
RID = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
CSV = b'name,n\r\n"ann, ""x""",1\n"bob\ny",22\n'


def archive(**parts) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def docx() -> bytes:
    body = (
        "<w:p><w:r><w:t>Hello</w:t><w:tab/><w:t>world</w:t></w:r><w:r><w:br/><w:t>!</w:t></w:r></w:p>"
        "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>in a table</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p/>"
    )
    return archive(**{"word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>"})


def pptx() -> bytes:
    ns = 'xmlns:p="urn:p" xmlns:a="urn:a"'
    shape = "<p:sp><p:txBody><a:p><a:r><a:t>{}</a:t></a:r></a:p><a:p><a:r><a:t>x</a:t></a:r><a:br/><a:r><a:t>y</a:t></a:r></a:p></p:txBody></p:sp>"

    def slide(text):
        return f"<p:sld {ns}><p:cSld><p:spTree>{shape.format(text)}<p:pic/></p:spTree></p:cSld></p:sld>"

    return archive(**{
        "ppt/presentation.xml": f'<p:presentation {ns} {RID}><p:sldIdLst><p:sldId id="256" r:id="r2"/><p:sldId id="257" r:id="r1"/></p:sldIdLst></p:presentation>',
        "ppt/_rels/presentation.xml.rels": f'<Relationships {REL}><Relationship Id="r1" Target="slides/slide1.xml"/><Relationship Id="r2" Target="slides/slide2.xml"/></Relationships>',
        "ppt/slides/slide1.xml": slide("second"), "ppt/slides/slide2.xml": slide("first"),
    })


def xlsx(far: bool = False) -> bytes:
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rows = (
        '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>n</t></is></c><c r="D1" t="str"><v>day</v></c></row>'
        '<row r="2"><c r="A2" t="s"><v>1</v></c><c r="B2"><v>1</v></c><c r="C2" t="b"><v>1</v></c><c r="D2" s="1"><v>45292</v></c></row>'
        '<row r="3"><c r="A3" t="s"><v>2</v></c><c r="B3"><v>2.5</v></c><c r="D3" s="1"><v>45293</v></c></row>'
    )
    if far:
        rows += '<row r="1048576"><c r="XFD1048576" t="str"><v>far</v></c></row>'
    return archive(**{
        "xl/workbook.xml": f'<workbook {ns} {RID}><sheets><sheet name="S" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships {REL}><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/sharedStrings.xml": f"<sst {ns}><si><t>name</t></si><si><t>ann</t></si><si><r><t>bo</t></r><r><t>b</t></r></si></sst>",
        "xl/styles.xml": f'<styleSheet {ns}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>',
        "xl/worksheets/sheet1.xml": f"<worksheet {ns}><sheetData>{rows}</sheetData></worksheet>",
    })


FILES = {
    "a.TXT": "Ünï text".encode(), "bad.txt": b"\xff\xfe\xfa", "r.rtf": rb"{\rtf1 hi}", "t.csv": CSV, "d.docx": docx(), "p.pptx": pptx(),
    "s.xlsx": xlsx(), "far.xlsx": xlsx(far=True), "broken.png": b"nope",
    "m.mp3": b"x", "v.mp4": b"x", "z.zip": b"x", "q.pdf": b"%PDF", "old.doc": b"x", "u.weird": b"x", "sub/noext": b"x", "broken.docx": b"x",
}
WANT = {
    "a.TXT": "Ünï text", "r.rtf": r"{\rtf1 hi}", "t.csv": 'name\tn\nann, "x"\t1\nbob\ny\t22\n',
    "s.xlsx": "name\tn\tday\nann\t1\tTrue\t45292\nbob\t2.5\t45293", "far.xlsx": "name\tn\tday\nann\t1\tTrue\t45292\nbob\t2.5\t45293\nfar",
    "d.docx": "Hello\tworld\n!\n\n", "p.pptx": "first\nx\vy\nsecond\nx\vy\n", "i.png": "Image: PNG, Size: (3, 2), Mode: RGB", "a +%b ü.png": "Image: PNG, Size: (4, 5), Mode: RGBA",
    "i.JPG": "Image: JPEG, Size: (30, 20), Mode: RGB", "i.gif": "Image: GIF, Size: (7, 9), Mode: RGB",
    "i.bmp": "Image: BMP, Size: (5, 6), Mode: RGB", "i.tiff": "Image: TIFF, Size: (11, 12), Mode: L",
    "m.mp3": X.AUDIO_TEXT, "v.mp4": X.VIDEO_TEXT, "z.zip": "", "u.weird": "", "noext": "",
}


# name: width, height, type of the JVM's image (1 RGB, 2 with alpha, 10 grey, 13 indexed)
IMAGES = {"i.png": (3, 2, 1), "sub/a +%b ü.png": (4, 5, 2), "i.JPG": (30, 20, 1), "i.gif": (7, 9, 13), "i.bmp": (5, 6, 1), "i.tiff": (11, 12, 10)}


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("files")
    for name, content in FILES.items():
        os.makedirs((root / name).parent, exist_ok=True)
        (root / name).write_bytes(content)
    jvm = spark._jvm
    for name, (width, height, kind) in IMAGES.items():
        image = jvm.java.awt.image.BufferedImage(width, height, kind)
        assert jvm.javax.imageio.ImageIO.write(image, name.rsplit(".", 1)[-1], jvm.java.io.File(str(root / name)))
    return str(root)


@pytest.fixture(scope="module")
def extracted(spark, root):
    raw = I.read_files(spark, root)
    images = I.image_texts(spark, root).join(raw.select(I.file_id().alias("file_id"), "path"), "path")
    files = I.ingest_files(raw)
    rows = files.join(I.extract_content(files, images), "file_id").drop("content").collect()
    return {r["filename"]: r for r in rows}


@pytest.mark.parametrize("name", list(WANT))
def test_text(extracted, name):
    assert extracted[name]["extracted_text"] == WANT[name]
    assert extracted[name]["extract_status"] == "ok"


def test_failures_are_rows(extracted):
    status = {n: extracted[n]["extract_status"] for n in ("bad.txt", "broken.png", "broken.docx", "old.doc")}
    assert status == {"bad.txt": "error", "broken.png": "error", "broken.docx": "error", "old.doc": "unsupported"}
    assert all(extracted[n]["extracted_text"] is None and extracted[n]["extract_error"] for n in status)
    assert extracted["q.pdf"]["extract_status"] == "unsupported"


def test_large_files_are_rows(spark, root, monkeypatch):
    files = I.ingest_files(I.read_files(spark, root, max_bytes=100))
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "100")  # a read of a larger file would end the job
    try:
        rows = {r["filename"]: r for r in files.join(I.extract_content(files), "file_id").collect()}
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert len(rows) == len(FILES) + len(IMAGES)
    assert rows["d.docx"]["content"] is None and rows["d.docx"]["extract_status"] == "error" and rows["d.docx"]["file_size"] > 100
    assert rows["a.TXT"]["extract_status"] == "ok"
    monkeypatch.setattr(D, "MAX_PART", 10)
    assert D.read_document(".docx", docx())[1] == "error"


def test_file_rows(extracted):
    row = extracted["a.TXT"]
    assert (row["file_type"], row["file_size"], row["source_type"], row["content_type"]) == (".txt", 10, "upload", "text")
    assert '"file_type":"text"' in row["metadata"]
    assert extracted["noext"]["file_type"] == "" and extracted["noext"]["content_type"] == "unknown"


def test_one_python_stage(spark, root):
    plan = I.extract_content(I.ingest_files(I.read_files(spark, root)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == plan.count("FileScan") == 2 and "Exchange" not in plan  # files up to the limit, and above


def test_ingest_is_repeatable(spark, root, folder):
    store = TableStore(spark, folder + "/store").create_tables()
    counts = {r[0]: r[1] for r in I.ingest(store, root).collect()}
    assert sum(counts.values()) == len(FILES) + len(IMAGES) and counts["ok"] == len(WANT)
    assert I.ingest(store, root).count() == 0
    files, texts = store.read("files"), store.read("processed_data")
    assert files.count() == len(FILES) + len(IMAGES) and texts.count() == counts["ok"]
    assert files.where("processed").count() == counts["ok"]
    assert R.unprocessed_files(files).count() == len(FILES) + len(IMAGES) - counts["ok"]
    assert files.where("filename = 'z.zip'").first()["content"] == b"x"
    preview = I.extraction_results(spark.createDataFrame(
        [("f", "text", "y" * 1001, "ok", None)],
        "file_id string, content_type string, extracted_text string, extract_status string, extract_error string")).first()
    assert preview["extracted_text"] == "y" * 1000 + "..." and preview["char_count"] == 1001


def test_csv_table(spark, tmp_path):
    (tmp_path / "t.csv").write_text("name,n\nann,1\nbob,22\n")
    table = I.read_csv_table(spark, str(tmp_path / "t.csv"))
    assert table.dtypes == [("name", "string"), ("n", "int")] and table.count() == 2


def test_export(spark, folder):
    df = spark.createDataFrame([(2, 'say "hi", you', bytearray(b"x"), [1]), (1, "line\nbreak", None, None)],
                               "k int, s string, b binary, a array<int>")
    E.export_csv(df, folder + "/all")
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(folder + "/all")
    assert {tuple(r) for r in back.collect()} == {("2", 'say "hi", you', "eA==", "[1]"), ("1", "line\nbreak", None, None)}
    E.export_page_csv(df, "k", folder + "/page", 1, 1)
    assert spark.read.option("header", True).csv(folder + "/page").columns == ["k", "s", "a"]


def test_explorer(spark):
    df = spark.range(95).select(F.col("id").alias("k"), F.lit(b"x").alias("content"))
    pages = [[r["k"] for r in E.page_rows(df, "k", p, 25).collect()] for p in range(4)]
    assert sum(pages, []) == list(range(95)) and len(pages[3]) == 20
    assert [r["k"] for r in E.page_after(df, "k", 74, 25).collect()] == pages[3]
    assert E.page_count(df, 25).first()["total_pages"] == 4
    profile = E.table_profile(df, "k")
    assert profile["row_count"].first()[0] == 95 and profile["columns"].count() == 2
    assert [r["k"] for r in profile["sample"].collect()] == [0, 1, 2, 3, 4]
    assert E.page_table(df, "k", 3, 25)["rows"].count() == 20


def test_free_sql(spark):
    df = spark.range(3)
    assert E.free_sql(spark, "SELECT count(*) AS n FROM t WHERE id < :top;", {"t": df}, {"top": 2}).first()["n"] == 2
    assert E.free_sql(spark, "WITH x AS (SELECT 'delete from' AS s) SELECT * FROM x").count() == 1
    assert "t" in [r["tableName"] for r in E.list_tables(spark).collect()]
    assert E.describe_table(spark, "t").first()["col_name"] == "id"
    for bad in ("DROP TABLE t", "INSERT INTO t VALUES (1)", "WITH x AS (SELECT 1) INSERT INTO t SELECT * FROM x",
                "WITH x AS (SELECT 1) /* */ insert overwrite t SELECT 1", "-- \nDELETE FROM t"):
        with pytest.raises(ValueError):
            E.free_sql(spark, bad)
    with pytest.raises(Exception):
        E.free_sql(spark, "SELECT 1; DROP TABLE t")


def test_files_without_a_byte_are_rows(spark, tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    for name in ("in/a.txt", "in/sub/a +%b ü.csv", "in/e.docx", "in/sub/z.zip"):
        (tmp_path / name).write_bytes(b"")
    (tmp_path / "in/b.txt").write_text("some words")
    raw = I.read_files(spark, str(tmp_path / "in"))
    assert {r["path"].rsplit("/", 1)[-1]: (r["length"], bytes(r["content"])) for r in raw.collect()} == {
        "a.txt": (0, b""), "a +%b ü.csv": (0, b""), "e.docx": (0, b""), "z.zip": (0, b""), "b.txt": (10, b"some words")}
    store = TableStore(spark, str(tmp_path / "store"), buckets=2).create_tables()
    assert {r[0]: r[1] for r in I.ingest(store, str(tmp_path / "in")).collect()} == {"ok": 4, "error": 1}  # an office file has to be an archive
    assert I.ingest(store, str(tmp_path / "in")).count() == 0
    files = {r["filename"]: r for r in store.read("files").collect()}
    texts = {r["file_id"]: r for r in store.read("processed_data").collect()}
    empty = texts[files["a.txt"]["file_id"]]
    assert (empty["extracted_text"], empty["word_count"], empty["char_count"]) == ("", 0, 0) and files["a.txt"]["file_size"] == 0
    (tmp_path / "none").mkdir()
    assert I.read_files(spark, str(tmp_path / "none")).count() == 0


LARGE = {
    "lines.txt": "".join(f"line {i} ünd 🙂 more\r\n" if i % 3 else "\n" for i in range(4000)),
    "noend.txt": "word " * 300 + "\n" + "last line",
    "bom.txt": "﻿" + "a b c\n" * 900,
    "bom2.txt": "﻿" + "a b c\n" * 900 + "x",
    "quoted.csv": "k,v\n" + "".join(f'{i},"a ""x"" {i}\nsecond, line\n\nthird"\r\n' if i % 5 == 0 else f"{i},plain {i}\n" for i in range(1500)),
    "one.csv": 'k,"' + "all in one cell\n" * 1000 + '"\nend,"x"',
    "open.csv": "k,v\n" + 'x,"never closed\n' + "1,2\n" * 800,
}


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_large_texts_in_parts_equal_the_whole(spark, tmp_path, small_splits):
    """With a small limit every file is read in parts; the parts put together are what one value would be."""
    (tmp_path / "in/sub").mkdir(parents=True)
    for name, text in LARGE.items():
        (tmp_path / "in/sub" / ("a +%b ü " + name)).write_bytes(text.encode())
    (tmp_path / "in/bad.txt").write_bytes(b"fine\n" * 500 + b"\xff\xfe\n" + b"fine\n" * 500)
    (tmp_path / "in/small.txt").write_text("small\n")
    folder = str(tmp_path / "in")
    whole, cut = (TableStore(spark, str(tmp_path / n), buckets=2).create_tables() for n in ("whole", "cut"))
    a = {r[0]: r[1] for r in I.ingest(whole, folder).collect()}
    b = {r[0]: r[1] for r in I.ingest(cut, folder, max_bytes=1000, part_bytes=3000).collect()}
    assert a == b == {"ok": len(LARGE) + 1, "error": 1}

    def texts(store):
        rows = store.read("processed_data").join(store.read("files").select("file_id", "filename"), "file_id").collect()
        out = {}
        for r in rows:
            out.setdefault(r["filename"], []).append(r)
        return out

    want, got = texts(whole), texts(cut)
    assert want.keys() == got.keys() and len(got["small.txt"]) == 1
    for name in LARGE:
        name = "a +%b ü " + name
        for count in ("word_count", "char_count"):
            assert sum(r[count] for r in got[name]) == want[name][0][count], (name, count)
        assert "bad.txt" not in got
        assert len(got[name]) > 1 or name.endswith(("one.csv", "open.csv", "noend.txt"))
    paths = [str(tmp_path / "in/sub" / ("a +%b ü " + n)) for n in LARGE]
    csv = F.col("path").endswith(".csv")
    parts = I.read_parts(spark, paths, csv, 3000).orderBy("path", "part").collect()
    for name, text in LARGE.items():
        own = [r for r in parts if r["path"].endswith("ü " + name)]
        assert [r["part"] for r in own] == list(range(len(own)))
        assert "".join(r["extracted_text"] for r in own) == text
    quoted = [r["extracted_text"] for r in parts if r["path"].endswith("quoted.csv")]
    assert len(quoted) > 5 and all(t.count('"') % 2 == 0 for t in quoted)


def test_lines_that_no_value_can_hold_are_errors(spark, tmp_path, monkeypatch):
    from doclake.sources import parts

    monkeypatch.setattr(parts, "MAX_LINE", 1000)
    monkeypatch.setattr(parts, "MAX_RECORD", 2000)
    (tmp_path / "long.txt").write_text("short\n" + "x" * 5000 + "\nshort\n")
    (tmp_path / "cell.csv").write_text('k,"' + "in a cell\n" * 900 + '"\n')
    (tmp_path / "good.txt").write_text("short\n" * 900)
    rows = parts.read_parts(spark, [str(p) for p in tmp_path.iterdir()], F.col("path").endswith(".csv"), 500).collect()
    errors = {os.path.basename(r["path"]): r["extract_error"] for r in rows if r["extract_error"]}
    assert errors == {"long.txt": "a line of more than 1000 bytes", "cell.csv": "a quoted cell of more than 2000 bytes"}
    assert "".join(r["extracted_text"] for r in sorted((r for r in rows if r["path"].endswith("good.txt")), key=lambda r: r["part"])) == "short\n" * 900
