"""Operators for training text: brute force, round trips, held-out accuracy and awkward tables."""

from __future__ import annotations

import itertools
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltline.llm import cuts, labelled, languages, lookalikes, mixing, packing, pairs, personal, scans, terms

POST = "row_no long, source struct<platform:string>, original_text string, ai_analysis struct<summary:string,topics:array<string>,subtopics:array<string>,concepts:array<string>>, kind string, label string, text string, term_id string, unified string, cut string"
MEDIA = "media_no long, post_id string, media_path string, media_type string, extracted_text string, what string, a string, word string, key string"
DOC = "doc_id long, text string, lang string, source string, code string, tokens string, main string"
REF = "term_id long, kind string, term string, aliases array<string>"


def post(n, text=None, summary=None, topics=None, platform="p"):
    return (n, (platform,), text, (summary, topics, None, None), "x", "x", "x", "x", "x", "x")


def media(n, text, post_id="p", path=None, kind="image"):
    return (n, post_id, path or f"m/{n}", kind, text, "x", "x", "x", "x")


def doc(n, text, lang="en", source="s"):
    return (n, text, lang, source, "x", "x", "x")


# ---- 1: labels


@settings(max_examples=150, deadline=None)
@given(st.text("abcd", max_size=7), st.text("abcd", max_size=7), st.text("abcd", max_size=7))
def test_distance_is_a_metric(a, b, c):
    d = terms.edit_distance
    assert (d(a, b) == 0) == (a == b) and d(a, b) == d(b, a) and d(a, c) <= d(a, b) + d(b, c)
    lev = terms.Pattern(a).distance(b)
    assert d(a, b) <= lev <= 2 * d(a, b)


def test_tree_finds_all_that_brute_force_finds():
    r = random.Random(1)
    words = {"".join(r.choice("abcde") for _ in range(r.randint(5, 11))) for _ in range(300)}
    tree = terms.BKTree()
    for k, w in enumerate(sorted(words)):
        tree.add(w, k)
    for q in r.sample(sorted(words), 40):
        q = q[:2] + q[3:] + "a"
        found = {(d, p) for d, ps in tree.within(q, 2) for p in ps}
        want = {(terms.edit_distance(q, w), k) for k, w in enumerate(sorted(words)) if terms.edit_distance(q, w) <= min(2, terms.threshold(len(w)))}
        assert found == want


LABELS = ["Data Quality", "data quality", "#DataQuality", "Quality, Data", "data-qaulity", "Datta Qualty", "intro to Data Quality", "Ｄａｔａ　Ｑｕａｌｉｔｙ", "Da​ta Quality", "Data Qualitys", "DQ tools", None, "", "  ", "​", "retry policy", "RP!", "kitchen recipes", "x" * 5000, "Data Quality"]


def test_labels(spark):
    ref = spark.createDataFrame([(1, "topic", "Data Quality", None), (2, "topic", "Retry Policies", ["RP"]), (3, "concept", "Kitchen Recipes", []), (4, "topic", None, None)], REF)
    p = spark.createDataFrame([post(1, topics=LABELS), post(2), post(3, topics=[])], POST)
    want = {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1, 7: 1, 8: 1, 9: 1, 10: 0, 15: 2, 16: 2, 17: 0, 18: 0}
    for shards in (None, 3):
        got = {(r.row_no, r.field, r.pos): r.term_id for r in terms.typed_labels(p, ref, shards).collect()}
        assert got == {(1, "topics", k): v for k, v in want.items()}
    assert {r.term_id for r in terms.typed_labels(p, ref.limit(0)).collect()} == {0}
    assert terms.typed_labels(p.limit(0), ref).count() == 0


def test_long_lists_are_counted_before_anything_is_broadcast(spark, monkeypatch):
    monkeypatch.setattr(terms, "BROADCAST_TERMS", 40)
    monkeypatch.setattr(terms, "PART_LABELS", 25)
    r = random.Random(4)
    names = sorted({"".join(r.choice("abcdefgh") for _ in range(9)) for _ in range(150)})
    ref = spark.createDataFrame([(k + 1, "topic", n, None) for k, n in enumerate(names)], REF)
    p = spark.createDataFrame([post(1, topics=[n[:4] + "z" + n[5:] for n in names])], POST)
    assert terms.shards_of(ref) == -(-len(names) // 40)
    sharded = {x.pos: x.term_id for x in terms.typed_labels(p, ref).collect()}
    assert sharded == {x.pos: x.term_id for x in terms.typed_labels(p, ref, 1).collect()} and sum(t > 0 for t in sharded.values()) > 100


def test_ties_are_unmatched(spark):
    ref = spark.createDataFrame([(1, "topic", "abcdefgh", None), (2, "topic", "abcdefgx", None)], REF)
    p = spark.createDataFrame([post(1, topics=["abcdefgy"])], POST)
    assert [r.term_id for r in terms.typed_labels(p, ref).collect()] == [0]


# ---- 2: look-alikes


def test_twins(spark):
    t = ["a naïve plan-b", "a naïve plan-b", "a naïve plan‑b", "ａ naïve plan-b", "а naïve plаn-b", "a na​ïve plan-b", "a naive plan-b", "a naïve plan b", "a naïve plan-c"]
    rows = [post(k, x) for k, x in enumerate(t)] + [post(20, t[0]), post(21, ""), post(22, None), post(23, "")]
    got = {(r.row_a, r.row_b) for r in lookalikes.visual_twins(spark.createDataFrame(rows, POST), "row_no", "original_text").collect()}
    same = [0, 1, 2, 3, 4, 5, 20]
    assert got == {(a, b) for a, b in itertools.combinations(same, 2) if (a, b) != (0, 20)}


def test_line_breaks_read_as_blanks(spark):
    t = ["one two\nthree", "one two three", "one  two\n\n three", "one\u00a0two\u2028three ", "onetwo three", "one two\nfour", "one two\nthree"]
    df = spark.createDataFrame([post(k, x) for k, x in enumerate(t)], POST)
    got = {(r.row_a, r.row_b) for r in lookalikes.visual_twins(df, "row_no", "original_text").collect()}
    assert got == {(a, b) for a, b in itertools.combinations([0, 1, 2, 3, 6], 2) if (a, b) != (0, 6)}
    classes = {r.row_no: (r.class_no, r.writing_no, r.n_writings) for r in lookalikes.visual_classes(df, "row_no", "original_text").collect()}
    assert classes == {0: (0, 0, 4), 1: (0, 1, 4), 2: (0, 2, 4), 3: (0, 3, 4), 6: (0, 0, 4), 4: (4, 4, 1), 5: (5, 5, 1)}
    assert {(r.class_no, r.writing_no) for r in lookalikes.writing_pairs(df, "row_no", "original_text").collect()} == {(0, 1), (0, 2), (0, 3)}


def test_half_of_all_rows_in_one_class_of_copies(spark):
    df = spark.createDataFrame([post(k, "the same text") for k in range(3000)] + [post(3000 + k, f"text {k}") for k in range(3000)] + [post(9000, "the\u200b same text")], POST)
    assert lookalikes.visual_twins(df, "row_no", "original_text").count() == 3000
    got = lookalikes.visual_classes(df, "row_no", "original_text").groupBy("class_no").count().orderBy(F.desc("count")).first()
    assert (got.class_no, got["count"]) == (0, 3001)


def test_rewriting_runs_to_its_fixed_point():
    r = lookalikes.Rewriter({c: 5 for c in "abcdefghijklmnopqrstuvwxyz -"})
    text = "a" + "\u200b\u0323".join("" for _ in range(2)) + "\u200b" * 40 + "\u0301 \u0430\u200b\u0308\u200b\u0304"
    once = r(text)
    assert r(once) == once and "\u200b" not in once


def test_unified_form_is_stable_and_keeps_the_rest(spark):
    text = "Ünḯ ﬁne — “q” 9º é‍ long " * 400
    r = lookalikes.Rewriter({c: 5 for c in "abcdefghijklmnopqrstuvwxyz -"})
    assert r(r(text)) == r(text) and "fine" in r(text) and "—" in r(text) and "é" in r(text) and "º" in r(text)
    df = spark.createDataFrame([post(1, text), post(2, None), post(3, "")], POST)
    out = {x.row_no: x.unified for x in lookalikes.unify_text(df, "original_text").collect()}
    assert out[2] is None and out[3] == ""
    assert lookalikes.unify_text(df.limit(0), "original_text").count() == 0


# ---- 3: scans

BODY = ["The pipeline reads each file once.", "Small files hurt the cluster a lot.", "The partition is easy to explain.", "Nobody reads the pipeline logs."]


def test_scan_defects(spark):
    clean = [media(100 + k, " ".join(BODY) * 3, post_id=f"c{k}") for k in range(12)]
    clean += [media(200 + k, "An event-driven partition reads the pipeline.", post_id=f"d{k}") for k in range(3)]
    rows = [
        media(1, "The parti-\ntion is easy to explain."), media(2, "An event-\ndriven partition reads."), media(3, "The pipelinc reads each file once."), media(4, "The p1peline reads each file."),
        media(5, "First Title Line\nSmall files hurt.\n3/4", post_id="q"), media(6, "FIRST TITLE LINE\nThe partition is easy.\n— 5 —", post_id="q"), media(7, "Nobody reads the pipeline.\n2.\nSmall files hurt.", post_id="r"),
        media(8, "Page 1 of 2\nSmall files\nPage 2 of 2\nhurt the cluster.", post_id="t", kind="pdf"), media(9, None), media(10, ""), media(11, "The p1peline reads each file.", post_id=None, path=None), media(12, "x " * 40000),
    ]
    rows += [media(300 + 2 * k + j, f"{t} Title Line\nSmall files hurt.", post_id=f"s{k}") for k, t in enumerate(["Second", "First", "Third"]) for j in (0, 1)]
    df = spark.createDataFrame(clean + rows, MEDIA)
    got = {(r.media_no, r.defect) for r in scans.scan_defects(df).collect() if r.media_no < 100}
    assert got == {(1, "hyphenation"), (3, "misread"), (4, "misread"), (5, "header"), (5, "page_number"), (6, "header"), (6, "page_number"), (8, "page_number"), (11, "misread")}
    text = {r.media_no: r.paragraphs for r in scans.repaired(df).collect()}
    assert text[1] == "The partition is easy to explain." and text[3] == "The pipeline reads each file once." and text[2] == "An event-driven partition reads."
    assert text[5] == "Small files hurt." and text[8] == "Small files hurt the cluster."


def test_misreads_inside_wide_glyphs(spark):
    assert {scans.skeleton(w) for w in ("cluster", "c1uster", "eluster", "duster")} == {scans.skeleton("cluster")} and scans.skeleton("hclps") == scans.skeleton("helps")
    body = "The cluster helps us and we use each clever parcel."
    rows = [media(k, f"{body} {body}", post_id=f"c{k}") for k in range(60)]
    rows += [media(100, "The c1uster helps us."), media(101, "The cluster hclps us."), media(102, "us and we ilse each clever"), media(103, "use each clever pared.")]
    df = spark.createDataFrame(rows, MEDIA)
    assert {(r.media_no, r.defect) for r in scans.scan_defects(df).collect()} == {(100, "misread"), (101, "misread")}
    text = {r.media_no: r.paragraphs for r in scans.repaired(df).collect()}
    assert text[100] == "The cluster helps us." and text[101] == "The cluster helps us." and text[102] == "us and we ilse each clever"


def test_scan_findings_know_no_lengths():
    body = "x" * 300
    words = " ".join(f"word{k}" for k in range(60))
    assert scans.title_parts(f"{words} Title") is not None and scans.title_parts("A b") is not None and scans.title_parts("what is a title?") is not None and scans.title_parts("what is a title?", False) is None
    assert scans.is_page_number("Page 123456 of 9999999") and scans.is_page_number(" " * 60 + "12345" + " " * 60) and not scans.is_page_number("1234567")
    assert scans.structure(" " * 80 + "17" + " " * 80 + "\n" + body, "image")[0]
    long = "a" * 200
    assert scans.structure(f"some {long}-\nrest of it", "image")[1] == [(long, "rest", "-")]
    pages = "\n".join(["The Same Title Line", "7"] * 8)
    assert scans.structure(f"a split par-\n{pages}\ntition follows", "pdf")[1] == [("par", "tition", "-")]
    assert scans.structure(f"a split par-\n{pages}\nA sentence.\ntition follows", "pdf")[1] == []


def test_repaired_text_is_whole_and_free_of_defects(spark):
    rows = [media(100 + k, " ".join(BODY) * 3, post_id=f"c{k}") for k in range(12)]
    rows += [media(300 + 2 * k + j, f"{t} Title Line {j}\nSmall files hurt the clus-\nter a lot.\nPage {j} of 9", post_id=f"s{k}") for k, t in enumerate(["Second", "First", "Third"]) for j in (0, 1)]
    rows += [media(1, None), media(2, ""), media(3, "  \n "), media(4, "3/4"), media(5, "The p1peline reads each file.\n— 5 —"), media(6, "First Title Line\n9", post_id="s1"), media(6, "First Title Line\n9", post_id="s1")]
    df = spark.createDataFrame(rows, MEDIA)
    out = scans.repaired(df)
    text = [(r.media_no, r.paragraphs) for r in out.collect()]
    assert len(text) == len(rows)
    assert dict(text)[1] is None and dict(text)[2] == "" and dict(text)[3] == "" and dict(text)[4] == "" and dict(text)[5] == "The pipeline reads each file."
    again = out.join(df.select("media_no", "post_id", "media_path", "media_type").dropDuplicates(), "media_no").withColumnRenamed("paragraphs", "extracted_text")
    assert scans.scan_defects(again).count() == 0


def test_one_post_with_half_of_all_items(spark):
    rows = [media(k, f"Shared Title Line\nSmall files hurt {k}.", post_id="hot") for k in range(1500)] + [media(5000 + k, f"Nobody reads file {k} at all.", post_id=f"p{k}") for k in range(1500)]
    rows += [media(9000 + k, f"Shared Topic{k % 3} Line\nSmall files.", post_id=f"s{k % 3}") for k in range(6)]
    got = scans.scan_defects(spark.createDataFrame(rows, MEDIA)).filter("defect = 'header' and media_no < 5000").count()
    assert got == 1500


def test_no_table_of_the_scans_is_broadcast(spark):
    rows = [media(k, f"Shared Title Line\nThe pipeline reads the parti-\ntion {k}.", post_id=f"s{k % 3}") for k in range(30)] + [media(100, "Nobody reads the p1peline of a partition.")]
    f = scans.Findings(spark.createDataFrame(rows, MEDIA))
    for out in (f.titles(), f.misread(), f.hyphens(), scans.misread_forms(f.counts)):
        assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
        assert out.count()


def test_bit_table_holds_the_bits_of_all_forms(spark):
    words = [f"form{k}" for k in range(20_000)]
    forms = spark.createDataFrame([(w,) for w in words], "bad string")
    for n in (1, len(words)):
        table = scans.bit_table(forms, "bad", n)
        bits = np.unpackbits(table, bitorder="little")
        assert set(np.flatnonzero(bits)) == set(scans._cells(words, len(bits).bit_length() - 1).reshape(-1).tolist())
        assert scans._hit(table, words) == words


def test_scans_of_nothing(spark):
    assert scans.scan_defects(spark.createDataFrame([], MEDIA)).count() == 0


@pytest.mark.parametrize(("line", "want"), [("Page 3", True), ("[12]", True), ("— 4 —", True), ("7/9", True), ("xiv", True), ("12", True), ("12.", False), ("19.1 s", False), ("x 4", False), ("", False), ("civil", False), ("12345678", False)])
def test_page_numbers(line, want):
    assert scans.is_page_number(line) is want


# ---- 4: personal data


@pytest.fixture(scope="module")
def field():
    return personal.trained()


def test_held_out_accuracy(field):
    held = labelled.labelled_texts(300, seed=4711)
    tp = fp = fn = 0
    for (_, spans), got in zip(held, personal.Decoder(field).find([t for t, _ in held]), strict=True):
        want, have = {(a, k) for a, _, k in spans}, {(a, k) for a, _, k in got}
        tp, fp, fn = tp + len(want & have), fp + len(have - want), fn + len(want - have)
    assert tp / (tp + fp) > 0.97 and tp / (tp + fn) > 0.97


def test_nothing_of_the_training_table_stands_in_the_texts():
    import pandas as pd

    d = "/root/testdata/sf0.01"
    texts = [t for t in pd.read_parquet(f"{d}/posts.parquet").original_text if t] + [t for t in pd.read_parquet(f"{d}/media_items.parquet").extracted_text if t]
    hay = " ".join(" ".join(texts).split()).lower()
    parts = {p.strip(" .,;:!?").lower() for ss in labelled.SENTENCES.values() for s in ss for p in re.split(r"\{\w+\}", s)}
    parts |= {x.lower() for x in [*labelled._PLURALS, *labelled._GROUPS]}
    long = [p for p in parts if len(p.split()) > 2 or (len(p) > 14 and " " in p)]
    assert len(long) > 150 and [p for p in long if p in hay] == []


# sentences of another hand than the training table's, with pieces in double brackets
OTHERS = [
    ("person", "Yesterday I had coffee with [[Chinedu Abiola]] in Lagos."), ("person", "The keynote of [[Ingeborg Hallström]] was brilliant."), ("person", "[[Rajesh Venkataraman]] maintains the library."), ("person", "Special thanks to my manager [[Sarah Whitcombe]] for the support."),
    ("person", "Interview with Prof. [[Matthias Kellerhoff]] next week."), ("person", "[[M. Castellanos]] asked a good question."), ("person", "Merci à [[Amélie Fontanelle]] pour son aide."), ("person", "Gracias a [[Rodrigo Valdivieso]] por la charla."),
    ("email", "Reach me at [[jane.q.public@widgets-inc.com]] any time."), ("email", "Resume to [[hr@acme.io]] please."), ("email", "Write to [[tom (at) startup (dot) io]] if interested."), ("email", "Contacto: [[ventas@tienda.es]]"),
    ("phone", "Call our support line [[+44 20 7946 0958]] today."), ("phone", "Office number: [[(212) 736-5000]]."), ("phone", "WhatsApp me on [[+91 98 76543 210]] please."), ("phone", "Tel. [[040 123 4567]] between nine and five."),
    ("id_number", "My social security number [[078-05-1120]] leaked."), ("id_number", "Passport no. [[C01234567]] was stolen."), ("id_number", "DNI [[12345678-Z]] caducado."), ("id_number", "Her national insurance number [[AB 12 34 56 C]] is in the file."),
    ("address", "Meet me at [[221B Baker Street, London]] at noon."), ("address", "We moved to [[1600 Amphitheatre Parkway, Mountain View 94043]]."), ("address", "Unser Büro: [[Friedrichstraße 43, 10117 Berlin]]."), ("address", "J'habite au [[12, rue de Rivoli, 75001 Paris]]."),
]


def test_pieces_of_another_hand(field):
    texts = [t.replace("[[", "").replace("]]", "") for _, t in OTHERS]
    found = personal.Decoder(field).find(texts)
    hit = [(t.index("[["), kind) in {(a, k) for a, _, k in got} for (kind, t), got in zip(OTHERS, found, strict=True)]
    missed = [kind for (kind, _), h in zip(OTHERS, hit, strict=True) if not h]
    # numbers, addresses and e-mail are told by their form; names without a common given name mostly aren't (README)
    assert set(missed) <= {"person"} and sum(hit) >= 17, missed


def test_addresses_of_any_length(field):
    host = ".".join(["verylonghostlabel"] * 12) + ".example"
    text = f"Orders for cakes: someone@{host}, please."
    got = [s for s in personal.Decoder(field).find([text])[0] if s[2] == "email"]
    assert [text[a:b] for a, b, _ in got] == [f"someone@{host}"]


def test_viterbi_is_the_best_of_all_paths(field):
    d = personal.Decoder(field)
    text = "Call 617-555 now"
    words, _, labels = d.labels([text, "x"])[0]
    x = np.pad(d.ids(words), personal.OFFSETS[-1])
    emit = sum(d.table[x[o : o + len(words)], o] for o in range(len(personal.OFFSETS)))
    n = len(personal.LABELS)

    def score(path):
        return field.first[path[0]] + sum(emit[t, k] for t, k in enumerate(path)) + sum(field.moves[a, b] for a, b in itertools.pairwise(path))

    best = max(itertools.product(range(n), repeat=3), key=lambda p: field.first[p[0]] + sum(emit[t, k] for t, k in enumerate(p)) + sum(field.moves[a, b] for a, b in itertools.pairwise(p)))
    one = d.labels(["Call 617 now"])[0]
    assert len(one[2]) == 3 and score(list(labels)) >= score([0] * len(words)) - 1e-3 and len(best) == 3


def test_personal_pieces_and_masks(spark, field):
    t = "Call (617) 555-0185 before noon. Ask Priya Pellocroft about the old cluster. Order 4561-74-5715 had the status code 2082 in every log line."
    df = spark.createDataFrame([post(1, t), post(2, None), post(3, ""), post(4, "word " * 30000), post(1, t)], POST)
    got = sorted((r.row_no, r.kind, r.start_pos) for r in personal.personal_pieces(df, ["row_no"], "original_text").collect())
    assert got == sorted([(1, "phone", 5), (1, "person", t.index("Priya"))] * 2)
    out = {r.row_no: r.masked for r in personal.without_personal(df, "original_text").collect()}
    assert out[1] == t.replace("(617) 555-0185", "[PHONE]").replace("Priya Pellocroft", "[PERSON]") and out[2] is None and out[3] == ""
    assert personal.personal_pieces(df.limit(0), ["row_no"], "original_text").count() == 0


# ---- 5: pairs


@pytest.mark.parametrize(
    ("question", "answer", "want"),
    [
        ("How does it work?", None, "empty_answer"), ("How does it work?", " ​", "empty_answer"), ("How does it work?", "(N/A)", "empty_answer"), ("How does the merge work?", "The merge job reads all the rows and then", "truncated_answer"),
        ("How does the merge work?", "Call f(x, the rest of it is lost.", "truncated_answer"), ("How does the merge work?", "I'm sorry, but I cannot help with that request.", "refusal"), ("Wie geht das mit der Tabelle?", "Leider kann ich diese Frage nicht beantworten.", "refusal"),
        ("How does the merge work?", "Answer: how does the merge work", "copies_question"), ("How would you find the rows before they reach the table?", "Wir haben gestern gemerkt, dass die Tabelle nicht fertig wurde und der Lauf zu lange war.", "other_language"),
        ("How does the merge work?", "Почему это работает так медленно и плохо.", "other_language"), ("How does the merge work?", "It reads rows.\n- one\n- two", None), ("How does the merge work?", "It reads rows.\nSELECT a FROM b", None), ("How many?", "Twice.", None),
        ("How?", "I can't use a broadcast join once the side is large.", None), (None, "A plain answer with words.", None), ("", "", "empty_answer"), ("How does it work?", "word " * 20000 + "end.", None),
    ],
)
def test_pairs(spark, question, answer, want):
    df = spark.createDataFrame([(question, answer, "clash")], "question string, answer string, defects string")
    d = pairs.judge_pairs(df).first().defects
    assert (d[0] if d else None) == want


@pytest.mark.parametrize(
    ("answer", "want"),
    [
        ("It reads the rows. Add a table and let the rest c...", "truncated_answer"), ("It reads the rows. Unab…", "truncated_answer"), ("It reads the rows. Then it […]", "truncated_answer"), ("It reads the rows in these steps:", "truncated_answer"),
        ("It reads rows.\n- one\n- tw...", "truncated_answer"), ("It reads the rows....", None), ("It reads the rows. …", None), ("It reads the rows.\n...", None), ('It only says "wait…"', None), ("It has no body.\ndef f(x): ...", None), ("...", "empty_answer"),
    ],
)
def test_dots_do_not_end_an_answer(spark, answer, want):
    df = spark.createDataFrame([("How does the merge work?", answer)], "question string, answer string")
    d = pairs.judge_pairs(df).first().defects
    assert (d[0] if d else None) == want


def test_a_long_refusal_is_a_refusal():
    assert pairs.defects_of("How does the merge work?", "I'm sorry, but I cannot help with that request because " + "it is long and winding and " * 30 + "so on.") == ["refusal"]
    assert pairs.defects_of("How does the merge work?", "The merge job reads all rows. I cannot say more.") == []


def test_every_triggered_defect_is_given():
    assert pairs.defects_of("How does the merge of the rows work for you?", "Leider kann ich diese Frage nicht beantworten, weil die Tabelle und") == ["refusal", "other_language", "truncated_answer"]
    assert pairs.defects_of(None, None) == ["empty_answer"] and pairs.defects_of("", "x" * 100_000 + ".") == []


def test_every_refusal_holds_one_of_the_words_it_is_looked_for_by():
    texts = ["I must decline.", "I would rather not respond.", "No reply can be given.", "I can't help.", "This isn't something I can answer.", "Answering this would break rules.", "I don't feel comfortable.", "It would be wrong.", "I won't be answering.", "That is outside what I am allowed to say.", "I may not comment.", "I have to pass on this.", "Please ask someone else.", "It is against my rules.", "I'm not permitted to.",
        "No puedo responder.", "Prefiero no hablar.", "Je ne peux pas répondre.", "Il m'est impossible de répondre.", "Leider kann ich das nicht sagen.", "Não posso responder.", "Prefiro não responder.", "Non posso rispondere.", "Preferisco non rispondere.", "Dat kan ik niet beantwoorden, ik kan het niet geven."]
    assert all(pairs.refuses(t) for t in texts), [t for t in texts if not pairs.refuses(t)]


def test_pairs_of_nothing(spark):
    assert pairs.judge_pairs(spark.createDataFrame([], "question string, answer string")).count() == 0


# ---- 6: cuts


def test_cuts(spark):
    r = random.Random(3)
    s = ["The merge job writes many small files.", "We keep one partition for each domain.", "Nobody reviewed the change feed before Monday.", "The lookup table keeps state for ever.", "A plain file is enough for most teams."]
    rows = [post(k, " ".join(r.choice(s) for _ in range(5)) + r.choice(["", "", "\n\n#kafka #sql", " To be continued..."])) for k in range(400)]
    cut = {}
    for k in range(400, 440):
        t = " ".join(r.choice(s) for _ in range(5))
        cut[k] = t[: len(t) - r.randint(5, 20)].rstrip() + r.choice(["", "…", " [...]", "...see more"])
    odd = [post(900, None), post(901, ""), post(902, " "), post(903, "word " * 20000 + "files."), post(904, rows[0][2]), post(905, s[0], platform=None)]
    df = spark.createDataFrame(rows + [post(k, t) for k, t in cut.items()] + odd, POST)
    got = {x.row_no for x in cuts.cut_values(df).filter("cut").collect()}
    assert len(got & set(cut)) >= 36 and len(got - set(cut)) <= 2
    assert cuts.cut_values(df.limit(0)).count() == 0


def test_copies_and_cut_titles_are_no_titles(spark):
    r = random.Random(5)
    s = ["The merge job writes many small files.", "We keep one partition for each domain.", "Nobody reviewed the change feed before Monday.", "Every team pays for latency.", "The slides explain the lookup table."]
    rows = [post(k, summary=" ".join(r.choice(s) for _ in range(4))) for k in range(300)] + [post(300 + k, summary=f"Notes on {w} and latency") for k, w in enumerate(["Flink", "Kafka", "Trino", "Glue", "Avro", "Hive"])]
    copies = [post(400 + k, summary="The merge job writes many sm") for k in range(3)]  # one text, captured three times
    cut = [post(410, summary="Notes on Spark and late"), post(411, summary="Notes on Delta and laten…")]
    got = {x.row_no for x in cuts.cut_values(spark.createDataFrame(rows + copies + cut, POST)).filter("cut").collect()}
    assert got >= {400, 401, 402, 410, 411} and not got & set(range(306))


# ---- 8, 9: packing and mixing


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 90), max_size=60), st.integers(1, 40))
def test_packing_is_exact(sizes, capacity):
    ids, tokens = np.arange(len(sizes)), np.array(sizes, dtype=np.int64)
    rows, piece, size, bins = packing.pack_group(ids, tokens, capacity)
    assert all(np.bincount(bins, size) <= capacity) if len(bins) else True
    for i, t in enumerate(sizes):
        mine = size[rows == i]
        assert mine.sum() == t and len(mine) >= 1
        if t <= capacity:
            assert len(mine) == 1
        else:
            assert sorted(piece[rows == i]) == list(range(len(mine))) and len(mine) == -(-t // capacity)


def test_packing_leaves_little_space(spark):
    r = random.Random(2)
    rows = [doc(k, "word " * r.randint(1, 300)) for k in range(500)] + [doc(900, None), doc(901, ""), doc(902, "long " * 5000), doc(903, "tie tie"), doc(904, "tie tie")]
    packs = spark.createDataFrame([("p", 512)], "pack_name string, capacity_tokens int")
    out = packing.pack_documents(spark.createDataFrame(rows, DOC), packs)
    assert {x.doc_id for x in out.select("doc_id").distinct().collect()} == {x[0] for x in rows}
    assert packing.pack_report(out, packs).first().fill > 0.97
    assert packing.pack_documents(spark.createDataFrame([], DOC), packs).count() == 0


def test_rates():
    held = {"a": 100, "b": 1000, "c": 0}
    r = mixing.rates_of({"a": (0.5, 2), "b": (0.5, 3), "c": (0.2, 9)}, held)
    assert r["a"] == 2 and r["c"] == 0 and abs(200 + r["b"] * 1000 - 1100) < 1e-9
    assert mixing.rates_of({"a": (0.0, 2)}, held) == {"a": 0.0}


def test_mixing(spark):
    rows = [doc(k, "word " * 20, source="big") for k in range(900)] + [doc(1000 + k, "word " * 20, source="small") for k in range(100)] + [doc(2000, None, source="big"), doc(2001, "", source="big"), doc(2002, "x y", source=None), doc(2003, "x", source="other")]
    targets = spark.createDataFrame([("m", "big", 0.7, 1), ("m", "small", 0.3, 5), ("m", "none", 0.0, 2), ("m", None, 0.5, 1)], "mix_name string, source string, target_share double, max_repeats int")
    df = spark.createDataFrame(rows, DOC)
    uses, shares = mixing.mix_documents(df, targets)
    got = {s.source: s for s in shares.collect()}
    assert abs(got["small"].actual_share - 0.3) < 0.03 and got["none"].tokens_used == 0
    u = uses.collect()
    assert max(x.uses for x in u if x.source == "small") <= 5 and max(x.uses for x in u if x.source == "big") == 1 and not {2000, 2001, 2002, 2003} & {x.doc_id for x in u}
    assert {(x.doc_id, x.uses) for x in u} == {(x.doc_id, x.uses) for x in mixing.mix_documents(df, targets)[0].collect()}
    assert mixing.mix_documents(df.limit(0), targets)[0].count() == 0


# ---- 10: languages

SAMPLES = {
    "en": "We keep one table for each domain because the team reads the plan before the merge runs.", "de": "Wir haben gestern gemerkt, dass die Tabelle nach dem Neustart nicht mehr fertig wurde.",
    "fr": "Nous avons découvert hier que la requête échouait après la reprise du traitement de nuit.", "es": "Ayer descubrimos que el proceso nocturno fallaba después de la carga por un error de tipos.",
    "pt": "Ontem descobrimos que o processo noturno falhava depois da carga por um erro de tipos.", "it": "Ieri abbiamo scoperto che il processo notturno falliva dopo il carico per un errore di tipo.", "nl": "Gisteren ontdekten we dat het proces na het laden vastliep door een fout in de types.",
}


def test_gradient_is_right():
    net = languages.Network(3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(1)
    blocks, live = rng.integers(0, 256, (5, 3, languages.BLOCK)).astype(np.uint8), np.ones((5, 3))
    live[3:, 1] = 0
    y = rng.integers(0, 7, (5, 3))
    _, g = net.gradient(blocks, live, y)
    for name in ("uf", "ub", "bf", "of", "ob", "tb"):
        p = net.p[name]
        at = tuple(rng.integers(0, s) for s in p.shape) if name != "tb" else (0, int(blocks[1, 0, 0]), 5)
        old = p[at]
        ends = []
        for e in (1e-4, -1e-4):
            p[at] = old + e
            ends.append(net.gradient(blocks, live, y)[0])
        p[at] = old
        assert abs((ends[0] - ends[1]) / 2e-4 - g[name][at]) < 2e-3 * max(1.0, abs(g[name][at])) + 2e-4, name


@pytest.fixture(scope="module")
def net(spark, small):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return languages.train(languages.training_sample(docs), steps=220)


def test_languages_of_unseen_sentences(net):
    texts = list(SAMPLES.values())
    for (code, t), p in zip(SAMPLES.items(), languages.label_positions(net, texts), strict=True):
        assert languages.judge(t, p)[0] == code


def test_language_cases(spark, net):
    mixed = SAMPLES["en"] * 6 + "\n" + SAMPLES["fr"]
    rows = [doc(1, SAMPLES["en"], "de-AT"), doc(2, SAMPLES["de"] * 3, "ger"), doc(3, mixed, "EN_us"), doc(4, SAMPLES["nl"], None), doc(5, None), doc(6, ""), doc(7, "12 !! 34"), doc(8, SAMPLES["en"] * 800, "en"), doc(1, SAMPLES["en"], "de-AT")]
    d = languages.document_languages(spark.createDataFrame(rows, DOC), net)
    got = sorted((r.doc_id, r.label_code, r.main) for r in d.collect())
    assert got == [(1, "de", "en"), (1, "de", "en"), (2, "de", "de"), (3, "en", "en"), (4, None, "nl"), (8, "en", "en")] or got == sorted([(1, "de", "en"), (1, "de", "en"), (2, "de", "de"), (3, "en", "en"), (4, None, "nl"), (8, "en", "en")], key=lambda r: (r[0], r[1] or ""))
    more = {r.doc_id: [m.code for m in r.more] for r in d.collect() if r.more}
    assert more == {3: ["fr"]}
    assert languages.language_cases(spark.createDataFrame([], DOC)).count() == 0


def test_short_sentences_of_another_language_count(spark, net):
    rows = [doc(1, SAMPLES["en"] * 4 + "\nWir haben gestern gemerkt, dass es nicht geht.\n" + SAMPLES["en"], "en"), doc(2, SAMPLES["en"] * 4 + " The word Tabelle is German. " + SAMPLES["en"], "en")]
    got = {(r.doc_id, m.code) for r in languages.document_languages(spark.createDataFrame(rows, DOC), net).collect() for m in r.more}
    assert got == {(1, "de")}


def test_reading_step_by_step_is_the_same_recurrence(net):
    rng = np.random.default_rng(2)
    blocks, live = rng.integers(0, 256, (40, 9, languages.BLOCK)).astype(np.uint8), np.ones((40, 9), np.float32)
    live[30:, 3] = live[5:, 8] = 0
    s = net.states(blocks, live, "f")[0] @ net.p["of"] + net.states(blocks, live, "b")[0] @ net.p["ob"] + net.p["o"]
    p = np.exp(s - s.max(-1, keepdims=True))
    assert np.abs(net.probabilities(blocks, live) - p / p.sum(-1, keepdims=True)).max() < 1e-4


def test_the_sample_does_not_depend_on_the_partitions(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert languages.training_sample(docs) == languages.training_sample(docs.repartition(7))


@pytest.mark.parametrize(("label", "want"), [("EN_GB", "en"), ("ger", "de"), (" Français ", "fr"), ("pt-BR", "pt"), ("xx", None), ("", None), (None, None), ("unknown", None), ("nl-BE", "nl")])
def test_labels_name_languages(spark, label, want):
    assert spark.createDataFrame([(label,)], "l string").select(languages.label_code(F.col("l")).alias("c")).first().c == want


def test_nothing_else_imports_the_subpackage():
    import pathlib

    root = pathlib.Path(languages.__file__).parents[1]
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert not re.search(r"siltline\.llm|from \.llm|import llm", f.read_text()), f
