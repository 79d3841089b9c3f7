"""Golden cases: best candidate ties, part assembly, tables, routing, file names."""

from pyspark.sql import functions as F

from pageflow.operators import documents as P
from pageflow.operators import routing as R


def test_best_candidate_ties_and_blanks(spark):
    rows = [(1, "pymupdf", 1, " ab "), (1, "pypdf2", 2, "ab"), (1, "ocr", 3, "a"),
            (2, "pymupdf", 1, "x"), (2, "pypdf2", 2, "xyz "), (2, "ocr", 3, "xyz"),
            (3, "pymupdf", 1, "  "), (3, "pypdf2", 2, ""), (3, "ocr", 3, "\n")]
    df = spark.createDataFrame(rows, "doc_id long, method string, method_rank int, text string")
    got = {r.doc_id: (r.text, r.method) for r in P.best_candidate(df).collect()}
    assert got == {1: (" ab ", "pymupdf"), 2: ("xyz ", "pypdf2"), 3: ("", "")}
    rep = P.extraction_report(P.best_candidate(df)).first()
    assert (rep.processed, rep.failed, rep.method_pymupdf, rep.method_pypdf2, rep.method_ocr, rep.text_length) == (2, 1, 1, 1, 0, 8)


def test_assemble_modes_and_document(spark):
    parts = spark.createDataFrame([(1, 2, "c"), (1, 0, "a"), (1, 1, ""), (1, 3, None)], "doc_id long, page_no long, text string")
    keep = P.assemble_parts(parts, "keep").first().text
    drop = P.assemble_parts(parts, "drop").first().text
    assert keep == "a\n\nc\n" and drop == "a\nc"
    tables = spark.createDataFrame([(1, 1, 0, [["k", None], ["x", "y"]]), (1, 1, 1, []), (1, 5, 0, [["z"]])],
                                   "doc_id long, page_no long, table_no int, cells array<array<string>>")
    urls = spark.createDataFrame([(1, "https://e.com/d.pdf")], "doc_id long, url string")
    doc = P.assemble_document(parts, tables, urls).first().text
    assert doc == "[Source](https://e.com/d.pdf)\n\na\n\n**Tableau:**\nk\t\nx\ty\nc\n\n**Tableau:**\nz\n"


def test_routes(spark):
    rows = [(404, "text/html", "https://e/a"), (500, "text/html", "https://e/b"), (200, "Application/PDF", "https://e/c"),
            (200, "text/plain", "https://e/x.PDF"), (200, "Text/HTML; charset=utf-8", "https://e/d"), (200, "image/png", "https://e/e")]
    df = spark.createDataFrame(rows, "s int, t string, u string")
    got = df.select(R.content_route("s", "t", "u").alias("a"), R.content_route("s", "t", "u", "permissive").alias("b"),
                    R.content_route("s", "t", "u", "html_only").alias("c")).collect()
    assert [r.a for r in got] == ["not_found", "error", "pdf", "pdf", "html", "unsupported"]
    assert [r.b for r in got] == ["error", "error", "pdf", "html", "html", "html"]
    assert [r.c for r in got] == ["error", "error", "skipped_non_html", "skipped_non_html", "skipped_non_html", "skipped_non_html"]


def test_filenames_second_order_collision(spark):
    rows = [(1, "h", "https://h/f/a.txt"), (2, "h", "https://h/g/a.txt"), (3, "h", "https://h/f/a_1.txt"),
            (4, "h", "https://h/"), (5, "h", "https://h/x/.bashrc"), (6, "h", "https://h/y/.bashrc"), (7, "h", "https://h/t.tar.gz"),
            (8, "h", "https://h/u/t.tar.gz")]
    df = spark.createDataFrame(rows, "page_id long, host string, url string").withColumn("category", F.lit("c"))
    got = {r.page_id: r.filename for r in R.assign_filenames(df, "page_id").collect()}
    assert got[1] == "a.txt" and got[2] == "a_1.txt" and got[3] == "a_1_1.txt"
    assert got[4].endswith(".unknown") and len(got[4]) == 32 + len(".unknown")
    assert got[5] == ".bashrc" and got[6] == ".bashrc_1"
    assert got[7] == "t.tar.gz" and got[8] == "t.tar_1.gz"


OUTCOMES = [  # (url, status, type, body, strict, html_only)
    ("https://e.com/1", 404, "text/html", "<p>same</p>", "not_found", "error"),
    ("https://e.com/2", 200, "text/html", "<p>same</p>", "html_ok", "html_ok"),
    ("https://e.com/3", 200, "text/html", "<p>same</p>", "duplicate", "duplicate"),
    ("https://e.com/a.zip", 404, "application/zip", "", "not_found", "error"),
    ("https://e.com/b.zip", 200, "application/zip", "", "downloaded", "downloaded"),
    ("https://e.com/i.html", 200, "text/html", "<p>page</p>", "html_ok", "html_ok"),
    ("https://e.com/j.html", 500, "text/html", "<p>page</p>", "error", "error"),
    ("https://e.com/4", 200, "image/png", "x", "unsupported", "skipped_non_html"),
    ("https://e.com/5", 200, "text/html", None, "parse_error", "parse_error"),
    ("https://e.com/6", 200, "text/html", None, "parse_error", "parse_error"),
    ("https://e.com/7", 200, "text/html", "<div></div>", "html_empty", "html_empty"),
    ("https://e.com/8", 200, "application/pdf", "<p>same</p>", "pdf_ok", "skipped_non_html"),
]


def test_outcomes_golden(spark):
    rows = [(i, "e.com", u, s, c, b, None) for i, (u, s, c, b, _, _) in enumerate(OUTCOMES)]
    df = spark.createDataFrame(rows, "page_id long, host string, url string, status_code int, content_type string, html string, fetch_ts timestamp")
    for k, mode in ((4, "strict"), (5, "html_only")):
        got = {r.page_id: r.outcome for r in R.crawl_outcome(df, mode).collect()}
        assert [got[i] for i in range(len(rows))] == [x[k] for x in OUTCOMES]
    raw = {r.page_id: r.outcome for r in R.crawl_outcome(df, html_as_page=False).collect()}
    assert raw[5] == "downloaded" and raw[6] == "error"


def test_many_methods_rank_by_length_then_order(spark):
    rows = [(1, f"m{k}", k, "x" * (5 if k in (1500, 2000) else 3)) for k in range(1, 2001, 100)] + [(1, "m1500", 1500, "x" * 5), (1, "m2000", 2000, "x" * 5)]
    df = spark.createDataFrame(rows, "doc_id long, method string, method_rank int, text string")
    assert P.best_candidate(df).first().method == "m1500"


def test_file_names_of_long_collision_chains(spark):
    """Each pass settles one more name of the chain; there are far more than any fixed number of passes."""
    rows = [(0, "https://e.com/a.txt"), (1, "https://e.com/a.txt")] + [(k, "https://e.com/a" + "_1" * (k - 1) + ".txt") for k in range(2, 12)]
    df = spark.createDataFrame([("e.com", i, u, "document") for i, u in rows], "host string, page_id long, url string, category string")
    names = [r.filename for r in R.assign_filenames(df, "page_id").collect()]
    assert len(set(names)) == len(rows)


def _sequential_names(rows):
    """One file after the other: the first name that is free."""
    import os

    taken, out = set(), {}
    for i, url, category in sorted(rows):
        original = url.rsplit("/", 1)[1]
        stem, ext = os.path.splitext(original)
        name, k = original, 0
        while (category, name) in taken:
            k += 1
            name = f"{stem}_{k}{ext}"
        taken.add((category, name))
        out[i] = name
    return out


def _named(spark, rows):
    df = spark.createDataFrame([("e.com", i, u, c, 7, "n") for i, u, c in rows], "host string, page_id long, url string, category string, z int, name string")
    got = R.assign_filenames(df.drop("z", "name"), "page_id")
    return {r.page_id: r.filename for r in got.collect()}


def test_file_names_equal_sequential_naming_on_a_chain(spark):
    """Every link of the chain moves the next one: 20 passes one after the other."""
    for late in (False, True):  # the doubled name before its chain, or behind it
        names = ["a.txt", "a.txt"] + ["a" + "_1" * k + ".txt" for k in range(1, 21)]
        rows = [(k, f"https://e.com/{n}", "document") for k, n in enumerate(names)]
        if late:
            rows = [(k if k else 99, u, c) for k, u, c in rows]
        assert _named(spark, rows) == _sequential_names(rows)


def test_file_names_equal_sequential_naming_on_random_collisions(spark):
    import random

    rng = random.Random(21)
    pool = ["a.txt", "a_1.txt", "a_2.txt", "a_3.txt", "a_1_1.txt", "a_1_2.txt", "a_2_1.txt", "a_1_1_1.txt", "a_10.txt", "a_01.txt", "a_0.txt", "b", "b_1", "b_2", ".c", ".c_1", "d..e", "d._1.e", "d.", "d_1.", "_1.txt", ".txt", ".txt_1"]
    rows, i = [], 0
    for trial in range(40):  # a category is a file system of its own
        few = rng.sample(pool, rng.randrange(2, 9))
        for _ in range(rng.randrange(3, 30)):
            rows.append((i, f"https://e.com/{rng.choice(few)}", f"c{trial}"))
            i += 1
    rows += [(100000 + 2 * k, "https://e.com/hot.pdf", "document") for k in range(700)] + [(99001 + 2 * k, f"https://e.com/hot_{k}.pdf", "document") for k in range(1, 800, 2)]
    rows += [(200000 + k, f"https://e.com/hot_{k}.pdf", "document") for k in range(600, 700)]
    got, want = _named(spark, rows), _sequential_names(rows)
    assert {k: (got.get(k), want[k]) for k in want if got.get(k) != want[k]} == {}
    assert len(got) == len(rows)
