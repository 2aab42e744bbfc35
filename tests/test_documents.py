"""Cut words, lost spaces, runs across formats, tracked changes, pictures of packages and names, against plain Python."""

import io
import math
import random
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from leafmill.operators import boundaries as B
from leafmill.operators import fragments as FG
from leafmill.operators import runs as RN
from leafmill.plans import runner
from leafmill.sources import ooxml

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def joined(spark, pages):
    rows = [(d, p, t) for d, ts in pages.items() for p, t in enumerate(ts)]
    got = FG.join_fragments(spark.createDataFrame(rows, "d string, p long, t string"), "d", "p", "t")
    assert got.columns == ["d", "p", "t", "kind", "taken"]
    out = {}
    for r in sorted(got.collect(), key=lambda r: (r.d, r.p)):
        out.setdefault(r.d, []).append((r.t, r.kind, r.taken))
    return out


def test_cut_words_and_sentences(spark):
    long = "Here are some words that go on until the page ends and"
    pages = {
        "hyphen": ["An indus-", "trial site.\nAll industrial goods."],
        "known": ["for", "mer days, a former king, for ever"],  # the first half is a word of its own elsewhere
        "bare": ["a sen", "tence is cut\nThe Sentence stands"],
        "unknown": ["a sen-", "tence is cut"],
        "capital": ["a sen-", "Tence sentence"],
        "furniture": ["the sen-\n3 / 9\n\n", "- 4 -\nhttp://x.y\n  tence went on.\nsentence"],
        "sentence": [long, "they stop here.", "More."],
        "upper": [long, "They stop here."],
        "five": [long, "one two three four five."],
        "quoted": [long, "it’s well-known.”\nNext"],
        "short": ["Too few before", "they stop."],
        "chain": ["x wor", "d", "wor", "d word"],
        "blank": ["word wor-", "\n \n", "d"],
        "null": ["word wor-", None],
    }
    got = joined(spark, pages)
    assert got["hyphen"] == [("An industrial", "word", "trial"), ("site.\nAll industrial goods.", None, None)]
    assert got["known"] == [("for", None, None), ("mer days, a former king, for ever", None, None)]
    assert got["bare"] == [("a sentence", "word", "tence"), ("is cut\nThe Sentence stands", None, None)]
    assert got["unknown"][0] == ("a sen-", None, None) and got["capital"][0] == ("a sen-", None, None)
    assert got["furniture"] == [("the sentence\n3 / 9\n\n", "word", "tence"), ("- 4 -\nhttp://x.y\nwent on.\nsentence", None, None)]
    assert got["sentence"] == [(long + " they stop here.", "sentence", "they stop here."), ("", None, None), ("More.", None, None)]
    assert got["upper"][0][1] is None and got["five"][0][1] is None and got["short"][0][1] is None
    assert got["quoted"] == [(long + " it’s well-known.”", "sentence", "it’s well-known.”"), ("Next", None, None)]
    # of two halves that are each a whole page, the second page goes to the first and takes nothing itself
    assert [k for _, k, _ in got["chain"]] == [None, None, None, None] or got["chain"][0][1] == "word"
    assert [k for _, k, _ in got["blank"]] == [None, None, None] and [k for _, k, _ in got["null"]] == [None, None]
    none = spark.createDataFrame([(None, 1, "sen-"), (None, 2, "tence sentence")], "d string, p long, t string")
    assert [r.kind for r in FG.join_fragments(none, "d", "p", "t").collect()] == [None, None]
    assert FG.join_fragments(none.filter("false"), "d", "p", "t").count() == 0


def cheapest(letters, costs, strange):
    best = [(0.0, 0)] + [(math.inf, 0)] * len(letters)
    for j in range(1, len(letters) + 1):
        for i in range(j):
            c = costs.get(letters[i:j], strange if j == i + 1 else None)
            if j == i + 1 and letters[i:j] in costs:
                c = min(c, strange)
            if c is not None and best[i][0] + c < best[j][0]:
                best[j] = best[i][0] + c, i
    ends, j = [], len(letters)
    while j:
        ends.append(j)
        j = best[j][1]
    return ends[::-1]


def test_lost_spaces(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcde") for _ in range(rng.randint(1, 6))) for _ in range(60)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 30))) for _ in range(200)]
    df = spark.createDataFrame([(t,) for t in [*texts, None, ""]], "t string")
    costs = B.word_costs(df, "t")
    counts = {}
    for t in texts:
        for w in t.split():
            counts[w] = counts.get(w, 0) + 1
    total = sum(counts.values())
    assert costs == pytest.approx({w: math.log(total / n) for w, n in counts.items()})
    few = B.word_costs(df, "t", most=5)
    assert list(few) == sorted(counts, key=lambda w: (-counts[w], w))[:5]
    for table in (costs, few, {}):
        trie = B.Trie(table)
        for _ in range(150):
            run = "".join(rng.choice("abcdez") for _ in range(rng.randint(0, 25)))
            assert trie.split(run) == cheapest(run, table, trie.strange)
    glued = df.withColumn("g", F.replace(F.col("t"), F.lit(" "), F.lit(""))).withColumn("r", B.restore(F.col("g"), costs))
    told = B.boundary_measures(F.col("t"), F.col("g"), F.col("r"))
    rows = glued.select("t", "g", "r", told[0].alias("recall"), told[1].alias("precision")).collect()
    for r in rows:
        if r.t is None:
            assert r.r is None
            continue
        assert r.r.replace(" ", "") == r.g

        def places(x):
            return {len(x[:i].replace(" ", "")) for i, c in enumerate(x) if c == " "}

        lost, added = places(r.t), places(r.r)
        assert r.recall == pytest.approx(len(lost & added) / len(lost) if lost else 1.0) and r.precision == pytest.approx(len(lost & added) / len(added) if added else 1.0)
    assert sum(r.recall for r in rows if r.t is not None) / len(texts) > 0.8
    trie = B.Trie({"many": 1.0, "see": 1.0, "friend": 1.0})
    assert trie.restored("Manyseefriend MANYSEE seefr12 éManySeefriend") == "Many see friend MANYSEE seefr12 éMany See friend"


def replaced(texts, needles, case_sensitive):
    runs = list(texts)
    for needle, new in needles.items():
        if not needle:
            continue
        whole, owner = "".join(runs), [i for i, t in enumerate(runs) for _ in t]
        out, done = [""] * len(runs), 0
        for m in re.finditer(re.escape(needle), whole, 0 if case_sensitive else re.I):
            for k in range(done, m.start()):
                out[owner[k]] += whole[k]
            out[owner[m.start()]] += new
            done = m.end()
        for k in range(done, len(whole)):
            out[owner[k]] += whole[k]
        runs = out
    return runs


@pytest.mark.parametrize("case_sensitive", [True, False])
def test_replacing_across_runs(spark, case_sensitive):
    rng = random.Random(6)
    rows, want = [], {}
    needles = {"ab": "a", "{{na}}": "X$1\\", "": "never", "b.": "", "A": "aa"}
    for block in range(150):
        texts = ["".join(rng.choice(["a", "b", "AB", "ab", "{{n", "a}}", ".", "é", ""]) for _ in range(rng.randint(0, 5))) for _ in range(rng.randint(1, 6))]
        want[block] = replaced(texts, needles, case_sensitive)
        rows += [("d", block, i, t, i % 2 == 0, "x") for i, t in enumerate(texts)]
    rows += [("d", 1000, 0, None, True, "x"), (None, 1, 0, "ab", True, "x")]
    df = spark.createDataFrame(rows, "doc string, block int, run int, text string, bold boolean, `__text` string")
    got = RN.replace_runs(df.drop("__text"), needles, case_sensitive)
    assert got.columns == ["doc", "block", "run", "text", "bold"]
    have = {(r.doc, r.block, r.run): r for r in got.collect()}
    assert len(have) == len(rows)
    for b, texts in want.items():
        assert [have["d", b, i].text for i in range(len(texts))] == texts
    assert have["d", 1000, 0].text is None and have[None, 1, 0].text == ("a" if case_sensitive else "aa") and have["d", 0, 0].bold
    with pytest.raises(ValueError):
        RN.replace_runs(df, {})


RUNS = "doc string, block int, run int, table int, row int, cell int, style string, text string, bold boolean, italic boolean, underline boolean, strike boolean, link string"


def test_markup_of_runs(spark):
    def run(block, n, text, style="Normal", table=None, row=None, cell=None, bold=False, italic=None, underline=None, strike=None, link=None):
        return ("d", block, n, table, row, cell, style, text, bold, italic, underline, strike, link)

    rows = [
        run(0, 0, "标题", "Heading1"), run(1, 0, "客户：{{na", bold=True), run(1, 1, "me}}，编号 {{id}}"), run(2, 0, "   "),
        run(3, 0, "项目", table=0, row=0, cell=0), run(4, 0, "金额|", table=0, row=0, cell=1), run(5, 0, "服务", table=0, row=1, cell=0), run(6, 0, "two", table=0, row=1, cell=0),
        run(7, 0, "a*b", "List Bullet", bold=True, italic=True, strike=True), run(8, 0, "x & y", "List Number", underline=True, link="http://h/(1)?a=1&b=2"), run(9, 0, None), run(9, 1, "", bold=True),
    ]
    df = spark.createDataFrame(rows, RUNS).repartition(3)
    text = RN.runs_markdown(df).first().text
    table = "| 项目 | 金额\\| |\n| --- | --- |\n| 服务<br>two |  |"
    assert text == "\n\n".join(["# 标题", "**客户：{{na**me}}，编号 {{id}}", "   ", table, "- ~~***a\\*b***~~", "1. [x & y](http://h/\\(1\\)?a=1&b=2)", ""])
    html = RN.runs_html(df).first().text
    cells = "<table><tr><th><p>项目</p></th><th><p>金额|</p></th></tr><tr><td><p>服务</p><p>two</p></td></tr></table>"
    assert html == "\n".join(["<h1>标题</h1>", "<p><strong>客户：{{na</strong>me}}，编号 {{id}}</p>", "<p>   </p>", cells, "<li><s><em><strong>a*b</strong></em></s></li>", '<li><a href="http://h/(1)?a=1&amp;b=2"><u>x &amp; y</u></a></li>', "<p></p>"])
    done = RN.replace_runs(df, {"{{name}}": "某", "{{id}}": "7"})
    assert "**客户：某**，编号 7" in RN.runs_markdown(done).first().text
    assert RN.runs_markdown(df.filter("false")).count() == 0


def tree(rng, enter, depth, rows, doc):
    """A node and all within; its rows are (doc, enter, leave, kind, text, format, mark, parent). Returns the next free number."""
    kind = rng.choice(["insert", "delete", "move_to", "move_from", "run", "text", "marker", "comment"]) if depth else "paragraph"
    at = len(rows)
    rows.append(None)
    n = enter + 1
    if kind not in ("text", "marker", "comment") and depth < 5:
        if rng.random() < 0.3:
            rows.append((doc, n, n + 1, "format", None, f"old{n}", None, enter))
            n += 2
        for _ in range(rng.randint(0, 3)):
            n = tree(rng, n, depth + 1, rows, doc)
    rows[at] = (doc, enter, n, kind, f"t{enter}" if kind == "text" else None, "new", rng.choice([None, "insert", "delete"]) if kind == "paragraph" else None, None)
    return n + 1


def revised(rows, mode):
    gone = {"accept": ("delete", "move_from"), "reject": ("insert", "move_to")}[mode]
    inside = lambda r: any(w[0] == r[0] and w[3] in gone and w[1] < r[1] and w[2] > r[1] for w in rows)
    kept = [r for r in rows if not inside(r) and r[3] not in ("insert", "delete", "move_to", "move_from", "marker", "comment")]
    old = {(r[0], r[7]): r[5] for r in kept if r[3] == "format"} if mode == "reject" else {}
    kept = sorted((r[0], r[1], r[3], r[4], old.get((r[0], r[1]), r[5]), r[6]) for r in kept if r[3] != "format")
    texts, runs_on = {}, {}
    for doc, enter, kind, text, _, mark in kept:
        if kind == "paragraph":
            if not runs_on.get(doc):
                texts.setdefault(doc, []).append("")
            runs_on[doc] = mark in gone
        elif kind == "text":
            texts[doc][-1] += text
    return kept, texts


@pytest.mark.parametrize("mode", ["accept", "reject"])
def test_revisions_as_a_tree(spark, mode):
    rng, rows = random.Random(1), []
    for doc in range(8):
        n = 1
        for _ in range(12):
            n = tree(rng, n, 0, rows, doc)
    df = spark.createDataFrame(rows, "doc int, enter int, leave int, kind string, text string, format string, mark string, parent int").repartition(3)
    kept, texts = revised(rows, mode)
    got = RN.apply_revisions(df, mode)
    assert got.columns == df.columns
    assert sorted(((r.doc, r.enter, r.kind, r.text, r.format, r.mark) for r in got.collect()), key=str) == sorted(kept, key=str)
    assert {(r.doc, r.paragraph): r.text for r in RN.revised_text(df, mode).collect()} == {(d, i + 1): t for d, ts in texts.items() for i, t in enumerate(ts)}
    assert len(kept) < len(rows) * 0.8
    with pytest.raises(ValueError):
        RN.apply_revisions(df, "keep")


def package(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in parts.items():
            z.writestr(name, data)
    return out.getvalue()


def test_pictures_go_and_charts_stay():
    names = f'xmlns:w="{W}" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:v="urn:schemas-microsoft-com:vml" xmlns:x="urn:x"'
    chart = "<w:drawing><x:chart/></w:drawing>"
    picture = '<w:drawing><a:blip r="1"/></w:drawing>'
    box = lambda inner: f"<w:drawing><x:box><w:p>{inner}</w:p></x:box></w:drawing>"
    body = f"<w:p>é{picture}{chart}{box('words ' + picture)}<w:pict><v:imagedata/></w:pict><w:pict><x:shape/></w:pict><w:drawing><a:blip/><x:t>{picture}</x:t></w:drawing><w:drawing/></w:p>"
    left = f"<w:p>é{chart}{box('words ')}<w:pict><x:shape/></w:pict><w:drawing/></w:p>"
    part = lambda x: f'<?xml version="1.0"?><w:document {names}>{x}</w:document>'.encode()
    rel = lambda kind, end: f'<Relationship Id="1" Type="http://o/{kind}" Target="t"{end}'
    rels = f"<Relationships>{rel('image', '/>')}{rel('chart', '/>')}{rel('image', '></Relationship>')}</Relationships>"
    before = package({"word/document.xml": part(body), "word/media/a.png": b"x", "word/charts/media/b.png": b"y", "word/_rels/document.rels": rels, "other.xml": b"<a>" + picture.encode() + b"</a>"})
    with zipfile.ZipFile(io.BytesIO(ooxml.drop_images(before))) as z:
        assert z.read("word/document.xml") == part(left)
        assert sorted(z.namelist()) == sorted(["word/document.xml", "word/charts/media/b.png", "word/_rels/document.rels", "other.xml"])
        assert z.read("word/_rels/document.rels").decode() == f"<Relationships>{rel('chart', '/>')}</Relationships>" and b"blip" in z.read("other.xml")


def test_runs_of_documents(spark):
    run = lambda text, *marks: f"<w:r><w:rPr>{''.join(marks)}</w:rPr><w:t>{text}</w:t></w:r>"
    cell = lambda *ps: "<w:tc>" + "".join(f"<w:p>{p}</w:p>" for p in ps) + "</w:tc>"
    body = "<w:p><w:pPr><w:pStyle w:val='Heading1'/></w:pPr>" + run("Head", "<w:b/>", '<w:i w:val="0"/>') + "</w:p>"
    body += '<w:p><w:hyperlink r:id="rId9">' + run("link", "<w:u w:val='single'/>", "<w:strike/>") + "</w:hyperlink><w:del><w:r><w:delText>old</w:delText></w:r></w:del><w:moveTo>" + run("moved") + "</w:moveTo></w:p><w:p/>"
    body += f"<w:tbl><w:tr>{cell(run('a'), run('b'))}{cell(run('c'))}</w:tr></w:tbl>"
    doc = f'<w:document xmlns:w="{W}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><w:body>{body}</w:body></w:document>'
    rels = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId9" Type="x" Target="http://h/"/></Relationships>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", doc)
        z.writestr("word/_rels/document.xml.rels", rels)
    files = spark.createDataFrame([("a.docx", bytearray(out.getvalue())), ("bad.docx", bytearray(b"no"))], "path string, content binary")
    rows = ooxml.document_runs(files)
    got = [tuple(r) for r in rows.filter("error is null").orderBy("block", "run").collect()]
    assert [(r[1], r[2], r[3:6], r[7], r[8:12], r[12], r[13]) for r in got] == [
        (0, 0, (None, None, None), "Head", (True, False, False, False), None, None),
        (1, 0, (None, None, None), "link", (False, False, True, True), "http://h/", None), (1, 1, (None, None, None), "old", (False,) * 4, None, "delete"), (1, 2, (None, None, None), "moved", (False,) * 4, None, "move_to"),
        (2, 0, (None, None, None), "", (False,) * 4, None, None),
        (3, 0, (0, 0, 0), "a", (False,) * 4, None, None), (4, 0, (0, 0, 0), "b", (False,) * 4, None, None), (5, 0, (0, 0, 1), "c", (False,) * 4, None, None),
    ]
    assert [r.doc for r in rows.filter("error is not null").collect()] == ["bad.docx"]
    assert RN.runs_markdown(rows.filter("error is null and coalesce(revision, '') <> 'delete'")).first().text == "# **Head**\n\n[~~link~~](http://h/)moved\n\n\n\n| a<br>b | c |\n| --- | --- |"


def test_no_two_names_are_the_same(spark):
    rng = random.Random(4)
    for _ in range(3):
        names = [rng.choice(["a", "a", "a", "a_1", "a_2", "a_3.txt", "a.txt", "a.txt", "a_01", "b.tar.gz", "a_1_1", None, ".hid", "x_"]) for _ in range(80)]
        taken = rng.sample(["a", "a_4", "a_5", "a_2.txt", "b.tar_1.gz", "c", "a_1_2"], 4)
        wanted = spark.createDataFrame(list(enumerate(names)), "o int, n string").repartition(3)
        got = {r.o: r.unique_name for r in runner.unique_names(wanted, "n", "o", spark.createDataFrame([(t,) for t in [*taken, taken[0], None]], "name string")).collect()}
        all_wanted, first, want = {n for n in names if n} | set(taken), set(taken), {}
        for o, n in enumerate(names):
            if n is not None and n not in first:
                first.add(n)
                want[o] = n
        used = set(all_wanted)
        for o, n in enumerate(names):
            if n is not None and o not in want:
                stem, suffix = re.fullmatch(r"(.*?)(\.[^.]*)?", n).groups()
                k = next(k for k in range(1, 999) if f"{stem}_{k}{suffix or ''}" not in used)
                want[o] = f"{stem}_{k}{suffix or ''}"
                used.add(want[o])
        assert got == want | {o: None for o, n in enumerate(names) if n is None}
        given = [x for x in got.values() if x]
        assert len(set(given)) == len(given) and not set(given) & set(taken)
    assert [r.unique_name for r in runner.unique_names(spark.createDataFrame([(1, "a"), (2, "a"), (3, "a_1")], "o int, n string"), "n", "o").orderBy("o").collect()] == ["a", "a_2", "a_1"]


def test_names_that_many_rows_want_are_dealt_by_stretches(spark, monkeypatch):
    monkeypatch.setattr(runner, "CELL", 7)
    wanted = spark.createDataFrame([(i, "a.txt" if i % 5 else "b") for i in range(200)], "o int, n string").repartition(3)
    got = [r.unique_name for r in runner.unique_names(wanted, "n", "o", spark.createDataFrame([("a.txt",), ("b_2",), ("b_3",)], "name string")).orderBy("o").collect()]
    assert [x for x in got if x[0] == "a"] == [f"a_{i}.txt" for i in range(1, 161)]
    assert [x for x in got if x[0] == "b"] == ["b", "b_1", *(f"b_{i}" for i in range(4, 42))]
