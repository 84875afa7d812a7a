"""Normalisers, the tagger, readers of text formats and of markup."""

import random

import numpy as np
from pyspark.sql import functions as F

from lacuna.functions import text as T
from lacuna.operators import vocab
from lacuna.sources import markup, tables


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expr(F.col("v")).alias("r")).first()["r"]


def test_normalisers(spark):
    assert one(spark, T.strip_title_brackets, " [A study]. ") == "A study."
    assert one(spark, T.strip_title_brackets, "[A] study") == "[A] study"
    assert one(spark, T.drop_wordless_brackets, "a ( - ) b [3] [ ] {;} (α)") == "a   b [3]      "
    assert one(spark, T.strip_control, " a\tb c\u0007 ") == "ab c"
    assert one(spark, T.sentences, "One. Two! Three? e.g.x") == ["One.", "Two!", "Three?", "e.g.x"]
    assert one(spark, T.sentences, "One two\nthree four. Five\n\nsix!\n Seven? ") == ["One two\nthree four.", "Five\n\nsix!", "Seven?"]
    assert one(spark, T.tokens, "Über-naïve Größe, 3 µg") == ["Über-naïve", "Größe", ",", "3", "µg"]
    assert one(spark, T.tokens, "The cell-wall (A).") == ["The", "cell-wall", "(", "A", ")", "."]
    assert one(spark, T.tokens, "x" * 900) == []


def test_years(spark):
    df = spark.createDataFrame([("1999", None), (None, "1998 Nov-Dec"), ("2001", "12/31/05"), ("2001", "1/2/99"), (None, None)], "y string, d string")
    got = df.select(T.simple_year(F.col("y"), F.col("d")).alias("a"), T.robust_year(F.col("y"), F.col("d"), 2024).alias("b")).collect()
    assert [r.a for r in got] == [1999, 1998, 2001, 2001, 0]
    assert [r.b for r in got] == [1999, 1998, 2005, 1999, None]


def plain_tag(tokens, words):
    tokens = [t.lower() for t in tokens]
    found = []
    for size in range(len(tokens), 0, -1):
        for at in range(len(tokens) - size + 1):
            key = tuple(tokens[at : at + size])
            if key in words:
                found += words[key]
                tokens[at : at + size] = [""] * size
    return found


def test_longest_match_against_brute_force(spark):
    rnd = random.Random(4)
    words = {}
    for i in range(40):
        words.setdefault(tuple(rnd.choices("abcde", k=rnd.randint(1, 4))), []).append(i)
    sentences = [[rnd.choice("abcdeXY") for _ in range(rnd.randint(1, 14))] for _ in range(150)]
    df = spark.createDataFrame([(i, 0, s) for i, s in enumerate(sentences)], "doc_id long, sentence int, tokens array<string>")
    keys = spark.createDataFrame([(list(k), i) for k, ids in words.items() for i in ids], "tokens array<string>, term_id long")
    got = {r.doc_id: list(r.ids) for r in vocab.tag(df, keys, 4).collect()}
    for i, s in enumerate(sentences):
        assert got.get(i, []) == plain_tag(s, words)


def test_dictionary(spark):
    terms = spark.createDataFrame([(0, "Heart attack|MI"), (1, "ab|the"), (2, "heart attack")], "term_id long, synonyms string")
    stop = spark.createDataFrame([("the",)], "term string")
    got = {(tuple(r.tokens), r.term_id) for r in vocab.dictionary(terms, stop, drop_short=True).collect()}
    assert got == {(("heart", "attack"), 0), (("heart", "attack"), 2)}


def test_vocabulary_files(spark, tmp_path):
    bars = lambda *a: "|".join(a)
    (tmp_path / "conso").write_text("\n".join([bars("C2", "ENG", *["-"] * 12, "Beta"), bars("C1", "ENG", *["-"] * 12, "Alpha"), bars("C1", "FRE", *["-"] * 12, "Non"), bars("C1", "ENG", *["-"] * 12, "alpha")]))
    (tmp_path / "sty").write_text("C1|T1\nC1|T0\nC2|T9\n")
    (tmp_path / "groups").write_text("CHEM|Chemicals|T1|Drug\nDISO|Disorders|T9|Finding\nPHEN|x|T0|y\n")
    concepts, types = tables.read_rrf_concepts(spark, str(tmp_path / "conso")), tables.read_rrf_types(spark, str(tmp_path / "sty"))
    selected = vocab.selected_types(tables.read_semantic_groups(spark, str(tmp_path / "groups")))
    assert [r.type_id for r in selected.collect()] == ["T1"]
    assert [tuple(r) for r in vocab.wordlist(concepts, types, selected).collect()] == [(0, "C1", ["T1"], ["alpha"])]
    assert [(r.cuid, r.types, r.term) for r in vocab.cuid_mapping(concepts, types).orderBy("cuid").collect()] == [("C1", ["T0", "T1"], "Alpha"), ("C2", ["T9"], "Beta")]
    full = vocab.wordlist(concepts, types)
    tables.write_wordlist(full, str(tmp_path / "list"))
    assert tables.read_wordlist(spark, str(tmp_path / "list")).collect() == full.orderBy("term_id").collect()


def test_records_matrices_and_factors(spark, tmp_path):
    (tmp_path / "mined").write_text("COOCCURRENCE\t1\t2\t1\nOCCURRENCE\t1\t1\nSENTENCECOUNT\t7\n")
    kinds = tables.read_mined(spark, str(tmp_path / "mined"))
    assert [tuple(r) for k in ("COOCCURRENCE", "OCCURRENCE", "SENTENCECOUNT") for r in kinds[k].collect()] == [(1, 2, 1), (1, 1), (7,)]
    (tmp_path / "rel").write_text("3 4 ignored\n5\t6\n")
    assert [tuple(r) for r in tables.read_relations(spark, str(tmp_path / "rel")).collect()] == [(3, 4), (5, 6)]
    (tmp_path / "u").write_text("% comment\n1 0.5 2\n2 1 1\n")
    assert [(r.x, r.f) for r in tables.read_factors(spark, str(tmp_path / "u")).collect()] == [(1, [0.5, 2.0]), (2, [1.0, 1.0])]
    vectors = spark.createDataFrame([(7, [1.0, 2.0]), (3, [0.5, -1.0])], "x long, vec array<float>")
    tables.write_float_matrix(vectors, str(tmp_path / "i"), str(tmp_path / "m"))
    assert np.fromfile(tmp_path / "m", "<f4").tolist() == [0.5, -1.0, 1.0, 2.0]
    back = tables.read_float_matrix(spark, str(tmp_path / "i"), str(tmp_path / "m"))
    assert sorted((r.x, r.vec) for r in back.collect()) == [(3, [0.5, -1.0]), (7, [1.0, 2.0])]
    assert tables.dump_vectors(back).count() == 4
    years = spark.createDataFrame([(2000, i) for i in range(5)] + [(2001, 9)], "year int, v int")
    tables.write_by_year(years, str(tmp_path / "y"), most_rows=2)
    assert tables.years_of(spark, str(tmp_path / "y")) == [2000, 2001]
    files = list((tmp_path / "y" / "year=2000").glob("*.parquet"))
    assert len(files) >= 3 and all(spark.read.parquet(str(f)).count() <= 2 for f in files)


CITATIONS = """<?xml version="1.0"?><MedlineCitationSet>
<MedlineCitation><PMID>11</PMID><Article><Journal><JournalIssue><PubDate><Year>1999</Year></PubDate></JournalIssue></Journal>
<ArticleTitle>[Old <i>title</i> here].</ArticleTitle><Abstract><AbstractText>A &amp;gt; B ( ).</AbstractText><AbstractText>Second.</AbstractText></Abstract></Article></MedlineCitation>
<MedlineCitation><PMID>12</PMID><Article><Journal><JournalIssue><PubDate><MedlineDate>2001 Jan</MedlineDate></PubDate></JournalIssue></Journal><ArticleTitle>T</ArticleTitle></Article></MedlineCitation>
</MedlineCitationSet>"""

ARTICLE = """<article xml:lang="en" article-type="research"><front><article-meta><article-id pub-id-type="pmid">5</article-id><article-id pub-id-type="doi">d/1</article-id>
<title-group><article-title>Main</article-title></title-group><pub-date><year>2010</year></pub-date><abstract><p>One <xref>3</xref> two</p><p>Three</p></abstract></article-meta></front>
<body><sec><title>Intro</title><p>Text<table>no</table> after</p></sec></body>
<sub-article><front-stub><title-group><article-title>Sub</article-title></title-group></front-stub><body><p>Deep</p></body></sub-article></article>"""


def test_citations(spark, tmp_path):
    (tmp_path / "c.xml").write_text(CITATIONS)
    got = {r.pmid: r for r in markup.read_citations(spark, str(tmp_path / "c.xml")).collect()}
    assert got["11"].pub_year == 1999 and got["12"].pub_year == 2001
    assert list(got["11"].blocks) == ["Old title  here.", "A > B  .", "Second."]
    (tmp_path / "bad.xml").write_text("<MedlineCitationSet><MedlineCitation><PMID>1</PMID><Article></MedlineCitation>" + CITATIONS[CITATIONS.index("<MedlineCitation>") :])
    both = markup.read_citations(spark, str(tmp_path / "bad.xml")).collect()
    assert sorted((r.pmid or "", r.error is None) for r in both) == [("", False), ("11", True), ("12", True)]
    left = markup.without_excluded(markup.read_citations(spark, str(tmp_path / "c.xml")), spark.createDataFrame([("11",)], "pmid string"))
    assert [r.pmid for r in left.collect()] == ["12"]


def test_articles(spark, tmp_path):
    (tmp_path / "a.nxml").write_text(ARTICLE)
    (tmp_path / "b.nxml").write_text("<article><front>")
    (tmp_path / "notes.txt").write_text("not an article")
    docs = markup.read_articles(spark, str(tmp_path))
    bad = docs.where("error is not null").collect()
    assert len(bad) == 1 and bad[0].path.endswith("b.nxml") and bad[0].part is None
    got = {r.part: r for r in docs.where("error is null").collect()}
    assert list(got["MAIN"].blocks) == ["Main", "One two", "Three", "Intro", "Text after"]
    assert list(got["SUB"].blocks) == ["Sub", "Deep"]
    assert got["SUB"].pmid == "5" and got["SUB"].pub_year == 2010 and got["MAIN"].doi == "d/1"
    assert sorted(r.part for r in markup.article_summary(docs).collect()) == ["MAIN", "SUB"]


def test_loose_html():
    page = "<html><head><title>x</title></head><body><nav>menu</nav><p>One <b>bold<p>Two &amp; three<script>var t='</p>'</script></body>"
    assert markup.html_blocks(page) == ["One bold", "Two & three"]
    assert markup.html_blocks(None) == []


def test_matrix_files(spark, tmp_path):
    pairs = spark.createDataFrame([(2, 5, 7), (1, 9, 1), (1, 3, 2)], "x long, y long, n long")
    tables.write_matrix(pairs, str(tmp_path / "m"))
    assert [p.read_text() for p in (tmp_path / "m").glob("part-*") if p.stat().st_size] == ["1\t3\t2\n1\t9\t1\n2\t5\t7\n"]
    assert sorted(map(tuple, tables.read_cooccurrences(spark, str(tmp_path / "m")).collect())) == [(1, 3, 2), (1, 9, 1), (2, 5, 7)]
    (tmp_path / "o").write_text("4\t2\n")
    (tmp_path / "i").write_text("4\n8\n")
    (tmp_path / "s").write_text("12\n")
    (tmp_path / "v").write_text("% values\n2.5\n\n1\n")
    assert [tuple(r) for r in tables.read_occurrences(spark, str(tmp_path / "o")).collect()] == [(4, 2)]
    assert sorted(r.x for r in tables.read_ids(spark, str(tmp_path / "i")).collect()) == [4, 8]
    assert tables.read_sentence_count(spark, str(tmp_path / "s")).first()["n"] == 12
    assert tables.read_singular_values(spark, str(tmp_path / "v")) == [2.5, 1.0]
    summary = spark.createDataFrame([("p1", "MAIN", "2001"), ("p2", "SUB", "2001"), ("p3", "MAIN", "2002")], "path string, part string, pub_year string")
    tables.article_lists(summary, str(tmp_path / "lists"))
    assert sorted((r.year, r.path) for r in spark.read.parquet(str(tmp_path / "lists")).collect()) == [(2001, "p1"), (2002, "p3")]
    years = spark.createDataFrame([(1799,), (1800,), (2025,), (2026,), (None,)], "y int")
    assert [r[0] for r in years.select(T.valid_year(F.col("y"), 2024)).collect()] == [False, True, True, False, None]


#: Sentences with slots, tags around terms, terms beyond ASCII, and noise between (terms, text).
CASES = [
    (2001, ["The heart attack and aspirin. Nothing here!", "Aspirin [ ] helps (;) the <b>naïve T-cell</b>."], "plain"),
    (2001, ["attack of the heart; ASPIRIN\u0007, aspirin? α-tocopherol\nand heart attack."], "noise"),
    (2002, ["α-Tocopherol. naïve T-cell aspirin heart"], "unicode"),
    (2002, [], "empty"),
]
TERMS = ["heart attack|MI", "aspirin", "naïve T-cell", "α-tocopherol", "heart", "attack"]


def test_texts_to_records_end_to_end(spark):
    """Markup to blocks, sentences, tokens, longest terms, pairs and counts, against plain Python."""
    import itertools
    import re
    from collections import Counter

    pages = spark.createDataFrame([(i, y, "<p>" + "</p><p>".join(blocks) + "</p>") for i, (y, blocks, _) in enumerate(CASES)], "doc_id int, year int, html string")
    docs = markup.html_to_blocks(pages, "html").select("doc_id", "year", "blocks")
    terms = spark.createDataFrame(list(enumerate(TERMS)), "term_id int, synonyms string").selectExpr("cast(term_id as long) term_id", "synonyms")
    words = vocab.dictionary(terms)
    from lacuna.operators import mine

    got = {(r.kind, r.year, r.x, r.y): r.n for r in mine.mine_texts(docs, words, 3).collect()}
    keys = {}
    token = r"[\w]+(?:[-'][\w]+)*|[^\s\w]"
    for i, synonyms in enumerate(TERMS):
        for s in synonyms.split("|"):
            keys.setdefault(tuple(re.findall(token, s.lower())), []).append(i)
    expected = Counter()
    for year, blocks, _ in CASES:
        for block in blocks:
            text = re.sub(r"<[^>]*>", " ", block.replace("\n", " "))
            for opening, closing in ("()", "[]", "{}"):
                text = re.sub(rf"(?a)\{opening}[\W\s]*\{closing}", " ", text)
            for sentence in filter(None, re.split(r"(?<=[.!?])\s+", text.replace("\u0007", "").strip())):
                expected["SENTENCECOUNT", year, None, None] += 1
                ids = sorted(set(plain_tag(re.findall(token, sentence), keys)))
                expected.update(("OCCURRENCE", year, x, None) for x in ids)
                expected.update(("COOCCURRENCE", year, x, y) for x, y in itertools.combinations(ids, 2))
    assert got == dict(expected)
    assert expected["COOCCURRENCE", 2001, 0, 1] == expected["COOCCURRENCE", 2001, 4, 5] == 1 and not expected["OCCURRENCE", 2002, 5, None]


def test_tokens_are_made_once_and_beginnings_looked_up_before_terms_are_cut(spark):
    sentences = spark.createDataFrame([(1, 0, ["A", "b", "c", "a"]), (1, 1, ["b"]), (2, 0, []), (3, 0, ["c", "a"]), (4, 0, None)], "doc_id long, sentence int, tokens array<string>")
    words = spark.createDataFrame([(["a", "b"], 7), (["a"], 1), (["b"], 2), (["b"], 3)], "tokens array<string>, term_id long")
    made = vocab.tag(sentences, words, 2)
    assert sorted((r.doc_id, r.sentence, r.ids) for r in made.collect()) == [(1, 0, [7, 1]), (1, 1, [2, 3]), (3, 0, [1])]
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line and "lambda" in line]


def test_records_become_rows_some_at_a_time():
    taken = []
    rows = ({"pmid": str(taken.append(i) or i), "titles": ["a"], "texts": []} for i in range(3 * markup.RECORDS))
    pieces = markup._in_pieces(rows, ["pmid", "titles", "texts", "error"])
    assert next(pieces).num_rows == len(taken) == markup.RECORDS
    assert [p.num_rows for p in pieces] == [markup.RECORDS] * 2
