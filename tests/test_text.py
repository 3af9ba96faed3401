import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as X
from quillspark.operators import chunking as C
from quillspark.sources import files

SAMPLE = """RBI/2036-37/88
Harbour Records Directions

1. Short title
1.1 These directions apply to every bank.

2. Reporting
[TABLE]
Item | Form | Due
Capital | A-1 | monthly
Assets | B-2 | weekly
[/TABLE]
2.1 Each bank shall report without delay. Late reports attract a penalty.

3. Penalty
3.1 A fine may be levied where reports are late."""


def one(spark, expr, text):
    return spark.createDataFrame([(text,)], "t string").select(expr(F.col("t"))).first()[0]


def test_normalise_and_extract(spark):
    assert one(spark, X.normalise_text, "a\r\nb  c\t d \n\n\n\n“x” – y\xa0z ") == 'a\nb c d\n\n"x" - y z'
    assert str(one(spark, X.extract_date, "31 February 2020, then April 3, 2021")) == "2021-04-03"
    assert one(spark, X.extract_date, "no date") is None
    assert one(spark, X.extract_doc_number, "see RBI/QQQ/2025-26/18") == "RBI/QQQ/2025-26/18"
    assert one(spark, X.supersedes_hint, "In supersession of para 6 of XYZ.ABC.DE.No.81/34.56.789/2025-26") == "XYZ.ABC.DE.No.81/34.56.789/2025-26"
    assert one(spark, X.supersession_scope, "supersedes clauses 3 to 5; amends the paragraph 3") == ["3", "5"]
    assert one(spark, X.extract_title, SAMPLE) == "Harbour Records Directions"
    assert one(spark, X.bm25_tokens, "The KYC of 6.1 shall apply") == ["kyc", "6.1", "apply"]
    assert one(spark, lambda c: X.bigrams(F.split(c, " ")), "x") == [] and one(spark, lambda c: X.bigrams(F.split(c, " ")), "a b c") == ["a b", "b c"]
    for f in (X.normalise_text, X.extract_date, X.extract_title, X.budget_tokens, X.slug):
        one(spark, f, None)
    assert one(spark, X.slug, "!!") == "document"


@pytest.mark.parametrize(("line", "level"), [("1. Head", 1), ("2.1 Sub head", 2), ("Annex I", 1), ("SHORT TITLE", 1), ("plain text", None), ("", None), ("25 February 2016", 1)])
def test_heading_level(spark, line, level):
    assert one(spark, X.heading_level, line) == level
    found = C.heading(line)
    assert (found[0] if found else None) == level


def test_chunkers(spark):
    made = C.structure_aware(SAMPLE, 120, 20)
    tables = [c for c in made if c[1] == "table"]
    assert len(tables) == 1 and "Capital | A-1 | monthly" in tables[0][0] and "Assets | B-2" in tables[0][0]
    assert any(c[2] and "Reporting" in c[2] for c in made) and any(c[0].startswith("[Section:") for c in made)
    long = " ".join(f"w{i}" for i in range(1000))
    assert all(C.count_tokens(c[0]) <= 200 for c in C.recursive(SAMPLE + "\n\n" + long, 80, 10))
    docs = spark.createDataFrame([("a", long), ("b", SAMPLE), ("c", ""), ("d", None)], "id string, t string")
    fixed = C.chunk(docs, "id", "t", "fixed", 100, 10).filter("id = 'a'").collect()
    assert len(fixed) > 5 and max(r.token_count for r in fixed) <= 110
    assert {r.id for r in C.chunk(docs, "id", "t").collect()} == {"a", "b"}
    with pytest.raises(ValueError, match="unknown chunker"):
        C.chunk(docs, "id", "t", "other")


def test_structure_aware_pieces():
    text = "Preamble of it.\n\n1. Head\nbody one\n\n2. Next\nbody | two |\n| three | four\n\nafter | one bar\nrow [TABLE] mark\n1. a | b\n\nc\n[/TABLE]\ntail"
    made = C.structure_aware(text, 350, 60, 0)
    assert [c[1] for c in made] == ["prose", "table", "prose", "table", "prose"]
    assert made[0][0] == "Preamble of it.\n\n1. Head\nbody one\n\n2. Next" and made[0][2] is None
    assert made[1][0] == "[Section: 2. Next]\nbody | two |\n| three | four" and made[3][0] == "[Section: 2. Next]\n1. a | b\n\nc"
    assert made[4][0] == "[Section: 2. Next]\ntail"
    merged = C.structure_aware(text, 350, 60, 40)
    assert len(merged) == 5  # small prose joins prose only, never over a table
    long = "\n\n".join(" ".join(f"w{i}" for i in range(n)) for n in (30, 30, 90, 10))
    parts = C.structure_aware("1. Head\n" + long, 50, 10, 5)
    assert [C.count_tokens(c[0].split("\n", 1)[1]) for c in parts] == [33, 30, 50, 50, 10, 10]
    assert C.structure_aware("1. Head\n\n" + "x " * 60 + "\n\n2. Two\nfew words", 50, 10, 40)[-1][0].endswith("\n\n[Section: 2. Two]\n2. Two\nfew words")
    assert C.structure_aware("", 50, 10) == []


def test_html_and_links(spark):
    text = files.html_to_text("<h1>T</h1><script>x</script><table><tr><td>A</td><td>B</td></tr><tr><td>1</td><td>2</td></tr></table>")
    assert "A | B" in text and "1 | 2" in text and "[TABLE]" in text and "x" not in text
    pages = spark.createDataFrame(
        [("http://h/a", '<a href="NotificationUser.aspx?Id=1">A long title</a><a href="other">not a document</a><a href="NotificationUser.aspx?Id=2">short</a>'), ("http://h/b", None)], "url string, html string"
    )
    assert [(r.url, r.title) for r in files.discover_links(pages).collect()] == [("http://h/NotificationUser.aspx?Id=1", "A long title")]


def test_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.txt").write_text("second")
    (tmp_path / "a.html").write_text("<p>third</p>")
    (tmp_path / "a.txt").write_text("first")
    (tmp_path / "README.md").write_text("no")
    (tmp_path / "bad.pdf").write_bytes(b"%PDF broken")
    rows = files.read_folder(spark, str(tmp_path)).orderBy("seq").collect()
    assert [r.raw for r in rows] == ["first", "second", None, "third"] and rows[2].error


def test_fetch_and_crawl(spark, tmp_path):
    page = "<p>" + "A stored page of a circular on harbour fees. " * 8 + "</p>"
    (tmp_path / "pages").mkdir()
    for name, body in (("1", page), ("2", "<p>tiny</p>")):
        (tmp_path / "pages" / name).write_text(body)
    folder = str(tmp_path / "pages")

    def get(url):
        if "list" in url:
            return b'<a href="NotificationUser.aspx?Id=1">Harbour fees circular</a><a href="NotificationUser.aspx?Id=2">Another circular</a><a href="NotificationUser.aspx?Id=3">A missing circular</a>'
        with open(f"{folder}/{url[-1]}", "rb") as f:
            return f.read()

    fetched, manifest = files.crawl(spark, ["http://h/list"], None, get)
    rows = {r.url[-1]: r for r in fetched.collect()}
    assert rows["1"].raw.startswith("A stored page") and rows["2"].error == "too short" and "FileNotFound" in rows["3"].error
    assert [(r.title, r.file) for r in manifest.collect()] == [("Harbour fees circular", "harbour-fees-circular.txt")]
    assert files.crawl(spark, ["http://h/list"], manifest, get)[1].count() == 1


def test_filled_ranges_overlap():
    assert list(C._filled([2, 2, 2, 9, 1, 1], 5)) == [(0, 2), (2, 3), (3, 4), (4, 6)]
    assert list(C._filled([2, 2, 2, 9, 1, 1], 5, 2)) == [(0, 2), (1, 3), (2, 4), (4, 6)]
    assert list(C._filled([], 5)) == [] and C.recursive(" \n\n ", 5, 1) == []
