import random

import numpy as np

from wordloom.llm import leaks, pii, pii_training, residue

from . import personal_texts, residue_texts

DOC = "doc_id bigint, text string, item_id string, ids string, row int, t string, v string"
ITEM = "item_id bigint, text string, doc_id int"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "x", "x", 1, "x", "x") for i, t in texts], DOC)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_words():
    assert leaks.words_of("It's <c>Weigh</c> 00:01:02.345 --> 00:01:03.000\nÉa-b_2") == ["it", "s", "weigh", "a", "b", "2"]
    assert leaks.words_of(None) == [] and leaks.words_of("") == []


def test_leaks_against_brute_force(spark):
    r = random.Random(4)
    pool = [f"w{k}" for k in range(40)]
    text = lambda n: " ".join(r.choice(pool) for _ in range(n))
    items = [(i, text(r.randrange(8, 40))) for i in range(30)] + [(100, None), (101, ""), (102, "w1 w2"), (103, None)]
    items += [(104, items[0][1]), (None, text(20))]
    corpus = [(i, text(r.randrange(0, 60))) for i in range(80)]
    for i in range(60):
        w = r.choice(items[:30])[1].split()
        n = r.choice([11, 12, 13, 20])
        a = r.randrange(max(1, len(w) - n))
        corpus.append((200 + i, f"{text(9)} other {' , '.join(x.upper() for x in w[a : a + n])}! {text(5)}"))
    corpus += [(300, None), (301, ""), (302, "   "), (303, " ".join([items[0][1]] * 3)), (303, items[0][1])]
    corpus += [(304, text(70_000) + " zz " + items[1][1]), (305, " ".join(reversed(items[2][1].split())))]
    grams = lambda t: {tuple(w[k : k + 12]) for w in [leaks.words_of(t)] for k in range(len(w) - 11)}
    want = sorted({(d, i) for d, t in corpus for i, s in items if i is not None and grams(t) & grams(s)})
    got = rows(leaks.leaked(docs(spark, corpus), spark.createDataFrame([(i, t, 1) for i, t in items], ITEM)))
    assert got == want and len(want) > 40


def test_leaks_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(leaks, "BLOCK_CHARS", 60)
    items = [(i, " ".join(f"a{i}b{k}" for k in range(14))) for i in range(4)]
    d = docs(spark, [(1, "x " + items[2][1]), (2, items[0][1] + " " + items[3][1]), (3, "nothing")])
    assert rows(leaks.leaked(d, spark.createDataFrame([(i, t, 1) for i, t in items], ITEM))) == [(1, 2), (2, 0), (2, 3)]
    assert leaks.leaked(d.limit(0), spark.createDataFrame([(1, items[0][1], 1)], ITEM)).count() == 0
    assert leaks.leaked(d, spark.createDataFrame([], ITEM)).count() == 0


def test_longest_common_run():
    assert leaks.longest_common_run(np.array([1, 2, 3, 4]), np.array([9, 2, 3, 8])) == 2
    assert leaks.longest_common_run(np.array([1]), np.array([2])) == 0


GOOD = ["We learn JavaScript by building a trowel timer, and you may enable every step.", "The old 404 bus to Saltrow was sturdy.", "Null and undefined are two different things, as the kiln example with print(f'{x}') shows.", 'In the lesson on page templates I explain why "{topic}" is swapped for the real value before the page is sent.', "A margin of error of 4 percent is fine when you sweep a trellis.", "The spec sheet lists {ripe, cheap, layered} as the set of finishes.", "[Applause] so <i>welcome</i> [Music] &gt;&gt; HOST: hello <|MASK|> there", "<html><body><title>Kilns</title><p>A kiln is warm.</p></body></html>", "© all rights reserved\nHome | Videos | About | Contact", "Printers used to set dummy words such as lorem ipsum so that nobody would read the page.", "12 345 678", "x" * 50_000]
BAD = ["Hi {{name}}, thank you for watching %%title%% on our channel.", "My kiln works. About the author: ${TAGS}. It is warm.", "Duration: NaN minutes. Hosted by undefined.", "TODO write intro about the loom.", "A kiln. [Your loom description goes here] by [Your Name] More.", "Lorem ipsum dolor sit amet. Enim minim veniam.", "asdf asdf asdf asdf", "HTTP ERROR 503\nThe server did not respond in time.", "<html><body><h1>404 Not Found</h1></body></html>", "Pléasé énable JavaScript to view this page.\nSkip to main content", "E 503 while loading clip", "Veuillez activer JavaScript pour afficher les sous-titres.", "Follow @@host@@ for more.", "A lamp. {% if guest %}Guest of the week: <episode>{% endif %}"]


def test_residue(spark):
    plain = [(1000 + i, f"Sentence {i} about the {w} kiln and the copper lamp that we like on this page, to view and read.") for i, w in enumerate(["warm", "cold"] * 40)]
    d = docs(spark, [(i, t) for i, t in enumerate(GOOD)] + [(100 + i, t) for i, t in enumerate(BAD)] + plain + [(500, None), (501, ""), (502, " \n\t")] + [(100, BAD[0])])
    assert [x[0] for x in rows(residue.find_residue(d))] == [100 + i for i in range(len(BAD))]
    kept = residue.without_residue(d)
    assert kept.columns == d.columns and kept.count() == len(GOOD) + len(plain) + 3
    assert residue.find_residue(d.limit(0)).count() == 0


PLAIN = [f"Sentence about the {w} kiln and the copper lamp that we like on this page, to view and read." for w in ["warm", "cold"] * 100]
PAGES = ["Please enable JavaScript to continue", "Lorem ipsum dolor sit amet", "This video is unavailable", "Error 404\nPage not found\nBack to start page", "Captions could not be loaded. Reload the player and try again."]


def test_residue_whose_page_is_a_third_of_the_rows(spark):
    for page in PAGES:
        d = docs(spark, [(1000 + i, t) for i, t in enumerate(PLAIN + ["Skip to main content\nReturn to the home page"])] + [(i, page) for i in range(100)])
        assert [x[0] for x in rows(residue.find_residue(d))] == list(range(100)), page


def test_short_filler_that_is_a_third_of_the_rows(spark):
    for page in ["Test. Test. 1 2 3", "Text.\nSample", "foo foo"]:
        d = docs(spark, [(1000 + i, t) for i, t in enumerate(PLAIN)] + [(i, page) for i in range(100)])
        assert [x[0] for x in rows(residue.find_residue(d))] == list(range(100)), page


HOLES = ["Songs by [artist] for you.", "We meet at {venue} today.", "Our %event% starts soon.", "Only in $store$ today.", "A talk from __show__ for you.", "A kiln {{ " + "very_" * 20 + "long }} here.", "A kiln [insert " + "a long and winding note about the loom " * 3 + "] here.", 'Now see our video "{{title}}" and the loom.', "Views: undefined\nA warm kiln.", "Posted by null. A warm kiln.", "Hello undefined, we fire the kiln."]
WHOLE = ["The soil has a low ph and the loom nullv is warm.", "A sign \ue000 of the private area.", "So [laughs] we met [inaudible] by [inaudible] there.", 'The template writes "{{title}}" where the loom goes.', "Known issues: none.", "It was hosted by Ann in the old mill.", "A line \\textbf{bold} and <strong>warm</strong>, import {kiln} too."]


def test_placeholders_of_any_name_length_and_quotes(spark):
    d = docs(spark, [(i, t) for i, t in enumerate(HOLES)] + [(100 + i, t) for i, t in enumerate(WHOLE)] + [(1000 + i, t) for i, t in enumerate(PLAIN)])
    assert [x[0] for x in rows(residue.find_residue(d))] == list(range(len(HOLES)))


def test_missing_values_in_a_third_of_the_rows(spark):
    d = docs(spark, [(i, "Duration: NaN minutes. A kiln.") for i in range(100)] + [(100 + i, t) for i, t in enumerate(WHOLE)] + [(1000 + i, t) for i, t in enumerate(PLAIN)])
    assert [x[0] for x in rows(residue.find_residue(d))] == list(range(100))


def test_tagger_on_held_out_lines():
    model = pii.default_model()
    data = [pii._lines_of(p) for p in pii_training.lines(800, 77)]
    p, _, _ = pii.beliefs(model, [[t] for t, _ in data])
    gold = np.array([y for _, ys in data for y in ys])
    best = p.argmax(axis=1)
    assert (best == gold).mean() > 0.99
    for k in range(1, len(pii.LABELS)):
        assert ((best == k) & (gold == k)).sum() / (gold == k).sum() > 0.93, pii.LABELS[k]
        assert ((best == k) & (gold == k)).sum() / max(1, (best == k).sum()) > 0.93, pii.LABELS[k]


def test_skip_edges_carry_labels():
    model = pii.default_model()
    toks = [pii.tokenize("Presented by Zorbina Quellwick"), pii.tokenize("Zorbina loved a kiln")]
    assert (model.skip >= 0).all() and model.skip[pii.LABELS.index("N")] > 0
    with_, a, b = pii.beliefs(model, [toks])
    without, _, _ = pii.beliefs(model, [[t] for t in toks])
    n = pii.LABELS.index("N")
    assert len(a) == 1 and with_[b[0], n] > without[b[0], n]


def test_personal_lines(spark):
    text = "Mail me: ann.lee@post.example\r\nOrder no. 4805-7572-11 of the kiln arrived\nPresented by Dr. Marcus Kormarkins\nOffice hours by phone: +44 7700 900716, at P.O. Box 12, Elmsea\nSSN 947-42-2565 (yes)\n\nFind us everywhere as @SlowChisel27"
    kind = "youtube_id string, description string, found int, redacted int, line_no int"
    df = spark.createDataFrame([("v", text, 1, 1, 1), ("v", text, 1, 1, 1), (None, text, 1, 1, 1), ("", text, 1, 1, 1), ("w", None, 1, 1, 1), ("x", "", 1, 1, 1), ("y", "a " * 20_000 + "\n" + "1" * 30_000, 1, 1, 1)], kind)
    assert rows(pii.personal_lines(df)) == [("v", 1, "email"), ("v", 3, "person_name"), ("v", 4, "address"), ("v", 4, "phone"), ("v", 5, "id_number")]
    red = {r.youtube_id: r.description for r in pii.redacted_descriptions(df).collect()}["v"].split("\n")
    assert red[0] == "Mail me: [EMAIL]\r" and red[1] == text.split("\n")[1] and red[2] == "Presented by [PERSON_NAME]" and "[PHONE]" in red[3] and "[ADDRESS]" in red[3] and red[4] == "SSN [ID_NUMBER] (yes)" and red[6].endswith("@SlowChisel27")
    assert pii.personal_lines(df.limit(0)).count() == 0


def test_long_lines_are_one_chain():
    model = pii.default_model()
    for lead in range(394, 404):
        line = "kiln " * lead + ". Presented by Dr. Marcus Kormarkins, call +44 7700 900716 now"
        (found,) = pii.spans(model, [line])
        assert [(line[a:b], kind) for _, a, b, kind in found] == [("Dr. Marcus Kormarkins", "N"), ("+44 7700 900716", "P")], lead


def test_blanks_of_no_width_keep_places():
    line = "Mail\xa0me: ​ann.lee@post.example"
    (found,) = pii.spans(pii.default_model(), [line])
    assert pii.replaced(line, found) == "Mail\xa0me: ​[EMAIL]"


def test_residue_on_held_out_texts(spark):
    sets = {**{k: (v, True) for k, v in residue_texts.residue().items()}, **{k: (v, False) for k, v in residue_texts.clean().items()}}
    assert all(len(v) >= 200 for v, _ in sets.values())
    every = [(k, t) for k, (v, _) in sets.items() for t in v]
    found = {r[0] for r in rows(residue.find_residue(docs(spark, [(i, t) for i, (_, t) in enumerate(every)])))}
    right = wrong = 0
    for kind, (_, want) in sets.items():
        mine = [i for i, (k, _) in enumerate(every) if k == kind]
        n = sum(i in found for i in mine)
        right, wrong = right + n * want, wrong + n * (not want)
        assert not want or n >= 0.95 * len(mine), kind
    assert right >= 0.98 * (right + wrong)


def test_shapes_of_slots():
    assert residue.slots("Hi {{ guest.city }}!")[:2] == residue.slots("Hi {{ user.name }}!")[:2] == ["{{a_b}}", "hi {{a_b}}"]
    assert residue.slots("so [laughs] we met [crowd cheering] <b>there</b> f(x) = {1, 2} and 5% to 10% of $3 and $4") == []
    assert "by [a]" in residue.slots("Songs by [artist]") and "by undefined" in residue.slots("It was hosted by undefined.")


def test_personal_information_in_held_out_lines():
    cases, clean = personal_texts.cases(), personal_texts.clean()
    got = [{pii.KINDS[x[3]] for x in g if x[3] != pii.MENTION} for g in pii.spans(pii.default_model(), [t for _, t in cases] + clean)]
    for kind in pii.KINDS.values():
        mine = [kind in g for (k, _), g in zip(cases, got) if k == kind]
        wrong = sum(kind in g for (k, _), g in zip([*cases, *[("", t) for t in clean]], got) if k != kind)
        assert len(mine) >= 200 and sum(mine) >= 0.88 * len(mine), kind
        assert sum(mine) >= 0.9 * (sum(mine) + wrong), kind


def test_parts_of_names_are_mentions(spark):
    text = "Guest: Maria Lopez\nThanks to Lopez for the tools\nThe old mill"
    df = spark.createDataFrame([("v", text)], "youtube_id string, description string")
    assert rows(pii.personal_lines(df)) == [("v", 1, "person_name")]
    assert pii.redacted_descriptions(df).first().description == "Guest: [PERSON_NAME]\nThanks to [PERSON_NAME] for the tools\nThe old mill"


def test_similar_tokens_share_a_key():
    assert pii.alike("word", "Raghunathan") == pii.alike("word", "RAGUNATHAN'S") and pii.alike("num", "+44 7700 900123") == pii.alike("num", "447700900123")
    assert pii.alike("word", "Lopez") == "lopez" and pii.alike("other", "!") is None


def test_near_leaks_recall(spark):
    r = random.Random(6)
    pool = [f"{a}{b}{c}" for a in "bdfglmnprst" for b in "aeiou" for c in ("n", "rt", "l", "st")]
    text = lambda n: " ".join(r.choice(pool) for _ in range(n))
    items = [(i, text(r.randrange(24, 60))) for i in range(40)] + [(900, None), (901, ""), (902, "too short")]

    def reworded(s):
        out = []
        for w in s.split():
            u = r.random()
            out += [] if u < 0.06 else [r.choice(pool)] if u < 0.15 else [w, "really"] if u < 0.2 else [w]
        return " ".join(out)

    planted = [(i, k, f"{text(20)} {reworded(' '.join(items[k][1].split()[:30]))} {text(15)}") for i, k in enumerate(r.randrange(40) for _ in range(120))]
    corpus = [(i, t) for i, _, t in planted] + [(1000 + i, text(60)) for i in range(200)] + [(2000, None), (2001, ""), (2002, items[0][1]), (2002, items[0][1])]
    got = {(d, i): s for d, i, s in rows(leaks.near_leaks(docs(spark, corpus), spark.createDataFrame([(i, t, 1) for i, t in items], ITEM)))}
    hit = sum((d, k) in got for d, k, _ in planted)
    assert hit >= 0.9 * len(planted) and got[2002, 0] == 1.0
    assert sum(d >= 1000 and d < 2000 for d, _ in got) <= 2
    assert leaks.near_leaks(docs(spark, corpus).limit(0), spark.createDataFrame([(1, items[0][1], 1)], ITEM)).count() == 0


def test_near_candidates_against_all_pairs(spark):
    r = random.Random(8)
    items = [(i, np.array([r.randrange(400) for _ in range(50)])) for i in range(30)]
    g = np.random.default_rng(2)
    index = leaks.NearIndex(items, g.standard_normal((400, 32)), np.ones(400))
    every = some = 0
    for i, ids in items:
        doc = np.array([r.randrange(400) if r.random() < 0.2 else x for x in ids])
        brute, near = index.search(doc, -2.0), index.search(doc)
        every, some = every + len(brute), some + len(set(brute) & set(near))
    assert every >= 20 and some >= 0.9 * every


def test_common_subsequence():
    a, b = np.array([1, 2, 3, 4, 5]), np.array([9, 1, 3, 8, 4])
    assert leaks.common_subsequence(a, b) == 3 and leaks.common_subsequence(a, a) == 5 and leaks.common_subsequence(a, np.array([], int)) == 0
