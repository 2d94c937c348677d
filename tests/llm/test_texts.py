import os
import random

import pytest
from pyspark.sql import functions as F

from minutebook.llm import byte_bpe, encodings, mixing, pieces, repeated_lines, scanned
from minutebook.session import cut


@pytest.mark.parametrize("text", ["", "short", "word " * 3000, "x" * 9001, "🙂é" * 4100, "A sentence. " * 900, "line\n" * 2000, "第一。" * 3000])
def test_pieces(spark, text):
    df = spark.createDataFrame([(1, text, "p"), (2, None, "p")], "record_id long, content string, text string")
    got = {r.record_id: r.pieces for r in pieces.with_pieces(df, "content", 4000, 200).collect()}
    assert got[2] == []
    rebuilt, end = "", 0
    for p in got[1]:
        assert len(p.text) <= 4000 and text[p.start : p.start + len(p.text)] == p.text
        assert p.piece_no == 0 or end - p.start == 200
        rebuilt += p.text[end - p.start :]
        end = p.start + len(p.text)
    assert rebuilt == text and (len(got[1]) > 1) == (len(text) > 4000)


def test_pieces_cut_at_boundaries(spark):
    df = spark.createDataFrame([("a b c. " * 500 + "\n\n" + "d e f. " * 500,)], "content string")
    first = pieces.with_pieces(df, "content", 4000, 200).first().pieces[0].text
    assert first.endswith("\n\n")


def test_repeated_lines(spark):
    notice = "These minutes are a summary only, see the recording"
    docs = spark.createDataFrame([(d, "agenda" if d < 10 else None, "x") for d in range(20)] + [(1, "agenda", "x")], "id long, kind string, leaf string")
    text = lambda d: f"Body {d} line of its own here {d}\n{notice.upper() if d % 2 else notice + '!'}\nshort line\n"
    pages = spark.createDataFrame([(d, d, text(d) if d < 5 else None if d == 6 else "x") for d in range(20)] + [(1, 1, text(1)), (99, 99, notice)], "id long, document_id long, content string")
    found = repeated_lines.repeated(pages, docs)
    assert {(r.page_id, r.line_no) for r in found.collect()} == {(d, 1) for d in range(5)}
    clean = {r.page_id: r.content for r in repeated_lines.without_repeated(pages, found).collect()}
    assert clean[0] == "Body 0 line of its own here 0\nshort line\n" and clean[6] is None
    assert repeated_lines.repeated(pages.limit(0), docs).count() == 0


def test_repeated_templates_equal_brute_force(spark):
    r = random.Random(9)
    names = ["ann", "bo", "cy", "dee", "eve", "flo", "gus", "hal"]
    docs = [(d, "agenda" if d % 3 else "minutes", "x") for d in range(30)]
    line = lambda: r.choice(["the motion of {n} was carried without a word", "please see the notice of the board outside", "{n} and {n} spoke of the {n} plan today", "item {k} was heard by the whole board"]).format(n=r.choice(names), k=r.randint(1, 3))
    pages = [(d * 10 + k, d, "\n".join(line() for _ in range(r.randint(1, 4)))) for d, _, _ in docs for k in range(2)]
    kind = {d: k for d, k, _ in docs}
    rows = [(kind[d], d, p, i, tuple(x.split())) for p, d, c in pages for i, x in enumerate(c.split("\n"))]
    total = {k: sum(v == k for v in kind.values()) for k in set(kind.values())}

    def often(items):
        held = {}
        for k, d, x in items:
            held.setdefault((k, x), set()).add(d)
        return {x for x, ds in held.items() if len(ds) >= 3 and len(ds) >= 0.3 * total[x[0]]}

    leaf = lambda w: (len(w), tuple("*" if any(c.isdigit() for c in x) else x for x in w[:4]))
    letters = lambda w: sum(x.isalpha() for x in w) >= 5
    rows = [x for x in rows if letters(x[4])]
    kept = often((k, d, (leaf(w), i, x)) for k, d, _, _, w in rows for i, x in enumerate(w))
    made = [(k, d, p, i, " ".join(x if (k, (leaf(w), j, x)) in kept else "*" for j, x in enumerate(w))) for k, d, p, i, w in rows]
    for slots in (0.0, 0.5):
        some = [x for x in made if x[4].split().count("*") <= slots * len(x[4].split())]
        covers = often((k, d, t) for k, d, _, _, t in some)
        want = {x[:4] for x in some if (x[0], x[4]) in covers}
        lines = repeated_lines.lines_of(spark.createDataFrame(pages, "id long, document_id long, content string"), spark.createDataFrame(docs, "id long, kind string, leaf string"))
        got = {(x.kind, x.document_id, x.page_id, x.line_no) for x in repeated_lines.templates(*lines, share=0.3, slots=slots).collect()}
        assert got == want and want


FILE = os.environ.get("MINUTEBOOK_TOKENIZER", byte_bpe.DEFAULT_FILE)
needs_file = pytest.mark.skipif(not os.path.exists(FILE), reason="no tokenizer file")


@needs_file
def test_ids_equal_the_public_tokenizer():
    import tiktoken

    bpe = byte_bpe.load(FILE)
    public = tiktoken.Encoding("t", pat_str=byte_bpe.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    r = random.Random(2)
    texts = ["", " ", "it's  they'll\n\n x", "x" * 5000, "the" * 3000, "é🙂漢" * 800, "퟿\x00"]
    texts += ["".join(r.choices("ab '\n\té漢🙂01-ls", k=r.randint(1, 4000))) for _ in range(60)]
    for t in texts:
        assert bpe.encode(t) == public.encode_ordinary(t)
        assert bpe.encode(t, block=r.choice([1, 16, 100])) == public.encode_ordinary(t)
        d = byte_bpe.Decoder(bpe)
        assert "".join(d.feed([i]) for i in bpe.encode(t)) + d.finish() == t


@needs_file
def test_encoded_rows(spark):
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "one two", 0), (3, "one two", 0)], "doc_id long, text string, ids int")
    assert sorted((r.doc_id, len(r.ids)) for r in byte_bpe.encoded(df).collect()) == [(1, 0), (2, 0), (3, 2), (3, 2)]
    assert byte_bpe.encoded(df.limit(0)).count() == 0


def test_mix(spark):
    r = random.Random(4)
    rows = [(i, "big" if i % 3 else "small" if i % 30 else None, r.randint(0, 40), 0) for i in range(4000)] + [(9000, "one", 35, 0)]
    sized = spark.createDataFrame(rows, "doc_id long, source string, tokens long, position int").select("doc_id", "source", "tokens")
    targets = spark.createDataFrame([("big", 0.3, 1), ("small", 0.4, 3), ("one", 0.2, 3), ("gone", 0.1, 1)], "source string, target_share double, max_repeats int")
    held = {s: sum(t for _, x, t, _ in rows if x == s) for s in ("big", "small", "one")}
    mix = mixing.mixed(sized, targets).cache()
    shares = {x.source: x for x in mixing.shares(mix, mixing.demands(sized, targets)).collect()}
    total = sum(held.values())
    for s, share, most in (("big", 0.3, 1), ("small", 0.4, 3), ("one", 0.2, 3)):  # to one document, or all repeats
        want = min(share * total, held[s] * most)
        assert abs(shares[s].tokens - want) <= 40 and shares[s].most_repeats <= most, s
        assert shares[s].capped == (held[s] * most < share * total) and abs(shares[s].lacking - (share * total - want)) <= 1
    assert shares["one"].most_repeats == 3 and shares["one"].capped and shares["gone"].tokens == 0
    assert abs(sum(x.actual_share for x in shares.values()) - 1) < 1e-9
    assert mix.groupBy("doc_id", "repeat").count().where("count > 1").count() == 0
    assert mix.where("position < 0 or position > 1").count() == 0 and mix.where("source is null or tokens = 0").count() == 0
    exact = {x.source: x for x in mixing.shares(mixing.mixed(sized, targets, total=mixing.EXACT), mixing.demands(sized, targets, mixing.EXACT)).collect()}
    assert exact["one"].tokens == 105 and abs(exact["big"].tokens - 105 * 0.3 / 0.2) <= 40 and not exact["one"].capped
    short = {x.source: x for x in mixing.shares(mixing.mixed(sized, targets, total=10**7), mixing.demands(sized, targets, 10**7)).collect()}
    assert short["small"].most_repeats == 3 and short["big"].most_repeats == 1 and short["big"].lacking > 0
    assert mixing.mixed(sized.limit(0), targets).count() == 0 == mixing.mixed(sized, targets.limit(0)).count()


def test_schedule(spark):
    # all of a only in the first half, b twice as often at the end as at the start, c by default
    sized = spark.createDataFrame([(i, "abc"[i % 3], 1) for i in range(3000)], "doc_id long, source string, tokens long")
    targets = spark.createDataFrame([(s, 1 / 3, 1) for s in "abc"], "source string, target_share double, max_repeats int")
    knots = [("a", 0.0, 1.0), ("a", 0.5, 1.0), ("a", 0.500001, 0.0), ("a", 1.0, 0.0), ("b", 0.0, 2.0), ("b", 1.0, 4.0), ("b", None, 9.0), ("c", 0.3, 0.0), ("x", 0.0, 1.0)]
    mix = mixing.mixed(sized, targets, schedule=spark.createDataFrame(knots, "source string, at double, weight double"))
    at = {s: sorted(x.position for x in mix.where(F.col("source") == s).collect()) for s in "abc"}
    assert [len(x) for x in at.values()] == [1000] * 3 and at["a"][-1] <= 0.5001 and abs(at["a"][500] - 0.25) < 0.002
    assert abs(sum(x < 0.5 for x in at["b"]) - 1000 * (2 * 0.5 + 0.25) / 3) < 3  # the integral of 2 + 2t up to a half over 3
    assert abs(at["c"][500] - 0.5) < 0.002


def test_buckets_do_not_change_what_comes_before(spark):
    sized = spark.createDataFrame([(i, "ab"[i % 7 == 0], i % 5) for i in range(500)], "doc_id long, source string, tokens long")
    for size in (7, 10**6):
        rows = mixing.laid_out(sized, "doc_id", size).collect()
        for s in "ab":
            own = sorted((r.before, r.tokens) for r in rows if r.source == s)
            assert all(a + t == b for (a, t), (b, _) in zip(own, own[1:])) and own[0][0] == 0


def test_encodings(spark):
    r = random.Random(6)
    clean = ["Después de la reunión, la comisión aprobó el año fiscal.", "Le théâtre a été rénové — déjà prévu.", "SÃO MIGUEL — NÃO ESTACIONAR", "№ 7 · Übergang · Ångstrom Hall", "§ 62.1 requires “a plan”", "plain"]
    rows = [(i, clean[i % len(clean)] + f" {r.randint(0, 9)}", r.choice("ab")) for i in range(600)]
    chains = [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "mac_roman"), ("utf-8", "cp437"), ("cp1252", "mac_roman")]
    bad = {}
    for k, (w, d) in enumerate(chains):
        for t in clean[:2] * 3:
            bad[1000 + len(bad)] = (t, t.encode(w).decode(d, "replace"))
    bad[2000] = (None, "lost � here")
    rows += [(i, b, "a") for i, (_, b) in bad.items()] + [(3000, None, "a"), (3001, "", None), (3002, "ñ" * 50_000, "b")]
    df = spark.createDataFrame([(*x, "c") for x in rows], "doc_id long, text string, source string, prior string")
    got = {x.doc_id: x for x in encodings.repaired(df).collect()}
    assert set(got) == set(bad)
    whole = [i for i, (t, b) in bad.items() if t and "�" not in b]
    assert sum(got[i].restored == bad[i][0] for i in whole) >= 0.9 * len(whole)
    assert encodings.repaired(df.limit(0)).count() == 0


def test_undo_inverts_every_chain():
    for k, steps in enumerate(encodings.CHAINS):
        for word in ("é", "—", "ñandú"):
            try:
                run = word
                for w, d in steps:
                    run = run.encode(w).decode(d)
            except UnicodeError:
                continue
            if all(c > "\x7f" for c in run):
                assert encodings.undo(run, k) in (word, run)


PAGE = """County Board Agenda / 01-02-2003 / Sheet 9{n}

The committee appr0ved the long-
term lease and recom¬
mended it to the council wit{h}in days.

482913
- {k} -"""


def test_scanned_pages(spark):
    body = "The committee approved the long-term lease and recommended it to the council within days.\n" * 40
    rows = [(k, 1, k, PAGE.format(n="   " + str(k) if k == 3 else "", h="b" if k == 2 else "h", k=k), "x") for k in (1, 2, 3)]
    rows += [(10, 2, 1, body, "x"), (11, 2, 2, None, "x"), (12, 3, 1, "", "x"), rows[0]]
    pages = spark.createDataFrame(rows, "id long, document_id long, page_number int, content string, sign string")
    found = scanned.faults(pages)
    got = {(r.page_id, r.line_no, r.fault) for r in found.collect()}
    want = {(k, i, f) for k in (1, 2, 3) for i, f in ((0, "header"), (2, "glyph"), (3, "hyphen"), (7, "page_number"))} | {(2, 4, "glyph")}
    assert want <= got
    assert not [x for x in got if x[1] == 2 and x[2] == "hyphen"] and not [x for x in got if x[0] >= 10 or x[1] == 6]
    scan = scanned.scanned(pages)
    text = [r.text for r in scanned.paragraphs(scan, found).where("document_id = 1").orderBy("paragraph").collect()]
    assert sum("approved the long-term lease and recommended it to the council within days." in t for t in text) == 3
    assert not [t for t in text if "Sheet" in t or t.startswith("-")] and text.count("482913") == 3
    empty = pages.limit(0)
    assert scanned.faults(empty).count() == 0 and scanned.paragraphs(scanned.scanned(empty), scanned.faults(empty)).count() == 0


def test_words_are_put_right_as_wholes():
    B, S = scanned.STATES.index("B"), scanned.STATES.index("S")
    fix = lambda line, was, now, fault="glyph": {"line_no": line, "fault": fault, "was": was, "now": now}
    lines = ["We searched the arc of the area", "and the plan¬", "ninq commis-", "sion met."]
    got = scanned.page_pieces(lines, [S, B, B, B], [fix(0, "arc", "are"), fix(1, "planninq", "planning"), fix(1, "plan-ninq", "planning", "hyphen"), fix(2, "commis-sion", "commission", "hyphen")])
    assert got == [("We searched the are of the area and the planning commission met.", True, False)]
    assert scanned.page_pieces(["a long-", "term lease and pre-"], [S, B], [fix(1, "pre-", "pre", "hyphen")]) == [("a long-term lease and pre", True, True)]
    assert scanned.page_pieces(["Footer"], [scanned.STATES.index("H")], [fix(0, None, None, "header")]) == []


def test_paragraphs_by_indent_and_over_pages(spark):
    para = lambda k: [f"   The board met on item {k} and heard the report of the", "clerk on the matter before it, which it took up again", "after the break and passed."]
    first = [x for k in range(6) for x in para(k)] + ["   The last item was put over to the meeting of the com-"]
    second = ["mittee on the day after, and the clerk was told of it.", *[x for k in range(6, 9) for x in para(k)], "   Members of the public spoke on the matter of the park"]
    third = ["and asked the board to keep it open.", *para(9)]
    rows = [(k * 10 + i, k, i, "\n".join(t)) for k in range(1, 6) for i, t in ((1, first), (2, second), (3, third))] + [(99, 1, 9, None), (98, 6, 1, "committee of the committee")]
    scan = scanned.scanned(spark.createDataFrame([*rows, rows[0]], "id long, document_id long, page_number int, content string"))
    got = scanned.paragraphs(scan, cut(scanned.faults_of(scan))).where("document_id = 2").orderBy("paragraph").collect()
    assert [r.text for r in got][:2] == [" ".join(x.strip() for x in para(k)) for k in range(2)] and [r.paragraph for r in got] == list(range(12))
    assert (got[6].text, got[6].first_page, got[6].last_page) == ("The last item was put over to the meeting of the committee on the day after, and the clerk was told of it.", 1, 2)
    assert got[10].text == "Members of the public spoke on the matter of the park and asked the board to keep it open." and len(got) == 12


def test_lone_page_numbers_misread_or_roman(spark):
    # the last line of each page is its number; the same marks in mid-page are body
    ends = ["l", "l4", "ll", "I", "iv", "XII", "1O", "|2", "Page l4", "l of 1O"]
    text = "\n\n".join(["The board met and heard the report of the clerk"] * 4)
    rows = [(i, i, f"{text}\n\nl\n\n{text}\n\n{e}") for i, e in enumerate(ends)] + [(i, i, f"{text}\n\n{text}\n\n{i}") for i in range(20, 60)]
    pages = spark.createDataFrame(rows, "id long, document_id long, content string")
    found = {(r.page_id, r.line_no) for r in scanned.faults(pages).where("fault = 'page_number'").collect()}
    assert found == {(i, len(c.split("\n")) - 1) for i, _, c in rows}
    for word in ("mix", "so", "to", "oil", "civil", ""):
        assert not scanned.LONE_NUMBER.match(word)
