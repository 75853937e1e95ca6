"""Tokens, leaks and personal information on small texts."""

import base64
import random
from pathlib import Path

import numpy as np
import pytest

from tilewright.llm import leaks, pii, tokens

needs_vocabulary = pytest.mark.skipif(not Path(tokens.VOCABULARY).exists(), reason="no vocabulary here")


@pytest.fixture(scope="module")
def direct():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tokens.VOCABULARY, "rb"))}
    public = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("own", pat_str=public, mergeable_ranks=ranks, special_tokens={})


TEXTS = ["", None, " ", "\n\n \t x", "it's we'll THEY'D", "<|endoftext|> [[a|b]] {{c}}", "x" * 20_000, "é́ß 🏔️🙃 日本語。 الميناء Ελλάδα", "a\u2003b\x85c\x1cd\xa0 e", "word " * 5000, "12345 ３４ ½ x² \u200bzero\r\n", "\ud7ff\ue000\U0010ffff"]


@needs_vocabulary
def test_ids_equal_direct_encoding(spark, direct, monkeypatch):
    docs = [(i, t, [1], "w") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], [1], "w"), (None, "null id", [1], "w")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, ids array<int>, word string")
    got = sorted((r.doc_id if r.doc_id is not None else -1, list(r.ids)) for r in tokens.encode_corpus(df).collect())
    assert got == sorted((i if i is not None else -1, direct.encode_ordinary(t or "")) for i, t, *_ in docs)
    back = {r.doc_id: r.text for r in tokens.decode_corpus(tokens.encode_corpus(df.filter("doc_id is not null").dropDuplicates(["doc_id"]))).collect()}
    assert back == {i: t or "" for i, t in enumerate(TEXTS)}
    assert tokens.encode_corpus(df.limit(0)).count() == 0


@needs_vocabulary
def test_blocks_do_not_matter(spark, direct):
    r = random.Random(1)
    docs = [(i, " ".join(r.choice(["alpha", "beta", "γάμμα", "don't", "7"]) for _ in range(r.randrange(40)))) for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    assert {r.doc_id: list(r.ids) for r in tokens.encode_corpus(df).collect()} == {i: direct.encode_ordinary(t) for i, t in docs}


@needs_vocabulary
def test_size_of_vocabulary_is_checked(spark, tmp_path):
    p = tmp_path / "v"
    p.write_bytes(b"x" * (tokens.MAX_VOCABULARY_BYTES + 1))
    with pytest.raises(ValueError):
        tokens.vocabulary(spark, str(p))


WORDS = "the a barge forest clay mill tower river was held near by old dry quiet market bridge school copper valley garden moved sold rebuilt often rarely within under beside lamp stone".split()


def brute_runs(doc, item):
    """Least edits between every stretch of the item and any stretch of the document, by plain tables."""
    best = dict.fromkeys(range(len(leaks.ENOUGH)), 0)
    for i in range(len(item)):
        prev = [0] * (len(doc) + 1)
        for n in range(1, len(item) - i + 1):
            cur = [n] + [0] * len(doc)
            for j in range(1, len(doc) + 1):
                cur[j] = min(prev[j - 1] + (doc[j - 1] != item[i + n - 1]), prev[j] + 1, cur[j - 1] + 1)
            for e in best:
                if min(cur) <= e:
                    best[e] = max(best[e], n)
            prev = cur
    return any(best[e] >= n for e, (n, _) in zip(best, leaks.ENOUGH, strict=True))


def edited(r, ws, n):
    ws = list(ws)
    for _ in range(n):
        k = r.randrange(len(ws))
        ws[k : k + 1] = r.choice([[], [r.choice(WORDS)], [ws[k], r.choice(WORDS)]])
    return ws


def test_leaks_equal_brute_force(spark):
    r = random.Random(4)
    items = [(i, " ".join(r.choice(WORDS) for _ in range(r.choice([12, 20, 30, 45])))) for i in range(8)]
    docs = []
    for d in range(40):
        ws = items[d % 8][1].split()
        n = r.randint(10, len(ws))
        a = r.randint(0, len(ws) - n)
        body = [r.choice(WORDS) for _ in range(15)] + edited(r, ws[a : a + n], r.randint(0, 5)) + [r.choice(WORDS) for _ in range(15)]
        docs.append((d, " ".join(body)))
    want = {(d, i) for d, t in docs for i, x in items if brute_runs(t.split(), x.split())}
    df, it = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    assert {tuple(x) for x in leaks.leaked_passages(df, it).collect()} == want
    assert 3 < len(want) < 60


PASSAGE = "The kiln of Marormere held 719 workshops for 149 years, and a quiet courtyard was openly surveyed by the bridge before it fell."


def test_leaks_through_markup(spark):
    dressed = [
        PASSAGE.upper(), PASSAGE.replace(" ", "\n"), PASSAGE.replace("Marormere", "[[Marormere (town)|Marormere]]").replace("quiet", "''quiet''"), "<!-- " + PASSAGE + " -->", "{{cquote|text=" + PASSAGE + "}}", "<ref>" + PASSAGE + "</ref>",
        PASSAGE.replace("years,", "years,<ref>{{cite web |title=x |url=https://a.example/1}}</ref>").replace("was", "'''was'''"), PASSAGE.replace(" ", "&nbsp;"), "{|\n| " + PASSAGE.replace(" ", " || ") + "\n|}", PASSAGE.replace("and", "{{citation needed|date=May 2010}} and"),
    ]
    plain = [" ".join(PASSAGE.split()[:14]), "", None, " ", "x" * 50_000]
    docs = [(i, t, "e") for i, t in enumerate([*dressed, *plain])] + [(0, dressed[0], "e"), (None, PASSAGE, "e")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, item_id string")
    it = spark.createDataFrame([(1, PASSAGE, 0), (2, None, 0), (3, "too short", 0), (None, PASSAGE, 0)], "item_id bigint, text string, doc_id int")
    assert sorted(map(tuple, leaks.leaked_passages(df, it).collect())) == [(i, 1) for i in range(len(dressed))]
    assert leaks.leaked_passages(df.limit(0), it).count() == 0 and leaks.leaked_passages(df, it.limit(0)).count() == 0


LONG = " ".join(f"{a}{b}" for a, b in zip("amber boat cedar delta ember fjord grove hedge inlet jetty knoll lodge moor nook orchard".split() * 2, "ing ed ly er est ful ish ness ward wise".split() * 3))


def test_leaks_whatever_parts_the_words(spark):
    """A passage alone in a comment, reference or template, its words parted by anything, at any depth, or dressed one by one."""
    ws = PASSAGE.split()[:22]
    dressed = [f % sep.join(ws) for f in ("<!-- %s -->", "<ref>%s</ref>", "<ref name=a>%s", "{{note|%s}}", "{{note|a|b=%s}}", "see {{a|{{b|c=%s}}}} there") for sep in ("\t", "\u00a0", "-", " ", "|")]
    dressed += ["{{q|" * 50 + " ".join(ws) + "}}" * 50, "[[a|" * 30 + " ".join(ws) + "]]" * 30, "<ref>" * 20 + " ".join(ws) + "</ref>" * 20, "{{x|" * 3000 + " ".join(ws) + "}}" * 3000]
    dressed += [" ".join(f"{{{{lang|en|{w}}}}}" if k % 3 == 0 else w for k, w in enumerate(LONG.split())), " ".join(f"{{{{{w}|x}}}}" if k % 9 == 8 else w for k, w in enumerate(LONG.split()))]
    dressed += ["x {{c|p}} " + PASSAGE + " {{d|q}} " * 40, " ".join(w + "<ref>{{cite web|title=t u v|url=w}}</ref>" for w in ws), " ".join(w + "<!-- a b -->" for w in ws)]
    df = spark.createDataFrame(list(enumerate(dressed)), "doc_id bigint, text string")
    it = spark.createDataFrame([(1, PASSAGE), (2, LONG)], "item_id bigint, text string")
    got = {r.doc_id: r.item_id for r in leaks.leaked_passages(df, it).collect()}
    assert got == {k: 2 if "boated" in t else 1 for k, t in enumerate(dressed)}


def test_leaks_of_long_items_and_texts(spark):
    """Passages anywhere in items of many segments, also of nothing but names, in long documents."""
    r = random.Random(9)
    item = [r.choice(WORDS) + str(r.randrange(40)) if k % 5 else r.choice(WORDS) for k in range(400)]
    names = [f"Nam{r.randrange(30)}e".replace("1", "x").replace("2", "y").title() for _ in range(60)]
    docs, want = [], set()
    for d in range(60):
        a, n, e = r.randrange(380), r.choice([19, 20, 21, 24, 33, 40, 90]), r.randint(0, 3)
        body = edited(r, item[a : a + n], e)
        ws = ["zo"] * r.randrange(300) + body + ["zo"] * r.randrange(300)
        docs.append((d, " ".join(ws)))
        want |= {(d, 1)} if brute_runs(["zo"] * 8 + body + ["zo"] * 8, item) else set()
    docs += [(100, " ".join(names[7:27])), (101, " ".join(names[7:24])), (102, " ".join(w.swapcase() for w in names[20:40]))]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    it = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(names))], "item_id bigint, text string")
    assert {tuple(x) for x in leaks.leaked_passages(df, it).collect()} == want | {(100, 2), (102, 2)}
    assert 10 < len(want) < 60


def test_least_hits_is_the_least():
    """Over all places of the edits: windows in unedited stretches that have another beside them or across one edit."""

    def splits(total, parts):
        if parts == 1:
            yield (total,)
            return
        for k in range(total + 1):
            for rest in splits(total - k, parts - 1):
                yield (k, *rest)

    least = []
    for n, e in leaks.ENOUGH:
        for lengths in splits(n - e, e + 1):
            own = [max(0, x - leaks.WINDOW + 1) for x in lengths]
            counted = [w if w > 1 or any(own[j] for j in (i - 1, i + 1) if 0 <= j < len(own)) else 0 for i, w in enumerate(own)]
            least.append(sum(counted))
    assert min(least) == leaks.LEAST_HITS


def test_foreign_text_of_names_gives_no_hits():
    """A text of words no item has, beside items of capitalised words, stays as small as it is: no window of it is wanted."""
    r = random.Random(3)
    coder = leaks.Coder(np.zeros(64, np.uint64))
    word = lambda: "".join(r.choice("aeioulmnrst") for _ in range(7))
    keys = [leaks.window_keys(coder.codes([word().title() for _ in range(60)])) for _ in range(240)]
    k = leaks.window_keys(coder.codes([word() for _ in range(20_000)]))
    assert not np.isin(k, np.concatenate(keys)).any()


def test_reparameterised(spark):
    other = PASSAGE.replace("719", "33").replace("149", "12").replace("Marormere", "Selunaport")
    df = spark.createDataFrame([(1, other), (2, PASSAGE), (3, "nothing here")], "doc_id bigint, text string")
    it = spark.createDataFrame([(1, PASSAGE), (2, "By 1700 Marormere was sold.  " + PASSAGE.replace("held 719", "fed 8"))], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r.changed_slots for r in leaks.reparameterised(df, it).collect()}
    assert got == {(1, 1): 3, (1, 2): 3}
    assert {tuple(x) for x in leaks.leaked_passages(df, it).collect()} == {(2, 1), (2, 2)}


TWICE = "The kiln of Marormere held 719 workshops for 149 years, 27 of them quiet, and a courtyard of 83 stones was surveyed by 46 men before it fell; later Marormere lost 15 of 38 kilns."
COPY = "The kiln of Selunaport held 33 workshops for 12 years, 51 of them quiet, and a courtyard of 62 stones was surveyed by 90 men before it fell."
AROUND = "Brumwick Taldor venir oskel marnit pulder fendrick wostel narbit quendor hestil vorpen " * 4
NUMBERED = "In 1801 there were 55 towers and 64 gates along the northern wall of the town where Marormere kept 719 barges and 81 mills beside 4 old bridges over the slow river."


def changed_slots(spark, texts, item):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    it = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    return {r.doc_id: r.changed_slots for r in leaks.reparameterised(df, it).collect()}


def test_reparameterised_inside_other_text(spark):
    texts = [
        COPY,
        COPY + " " + AROUND,
        AROUND + COPY + " " + AROUND,
        COPY + " later Selunaport lost 77 of 44 kilns.",
        # a run that holds both places has two values for one name; a shorter one is a passage too
        COPY + " later Ostelberg lost 77 of 44 kilns.",
    ]
    assert changed_slots(spark, texts, TWICE) == {0: 6, 1: 6, 2: 6, 3: 8, 4: 8}



def test_reparameterised_across_added_and_dropped_words(spark):
    other = "In 1755 there were 12 towers and 31 gates along the northern wall of the town where Selunaport kept 33 barges and 17 mills beside 9 old bridges over the slow river."
    texts = [other, other.replace("northern wall", "northern and wall"), other.replace("the northern wall", "the wall"), AROUND + other.replace("of the town", "of the small town") + " " + AROUND]
    assert changed_slots(spark, texts, NUMBERED) == {k: 7 for k in range(4)}


def test_reparameterised_needs_one_value_for_a_slot(spark):
    item = "by 719 the mill held 719 barges and 719 towers near 719 gates while 719 bridges of the 719 wards fell into 719 parts of 719 stones"
    same, parts = item.replace("719", "33"), item.split("719")
    assert changed_slots(spark, [same, "".join(f"{p}{k + 10}" for k, p in enumerate(parts[:-1])) + parts[-1]], item) == {0: 1}


DENSE = "by {0} the mill held {1} barges and {2} towers near {3} gates while {4} bridges of the {5} wards fell into {6} parts of {7} stones"


def test_reparameterised_when_many_items_have_the_template(spark):
    """Every window holds a slot, so nothing but the templates is shared, and each stands in as many places as there are items."""
    items = [(i, DENSE.format(*range(100 * i, 100 * i + 8))) for i in range(12)]
    docs = [(1, AROUND + DENSE.format(*range(7001, 7009)) + " " + AROUND), (2, items[3][1])]
    df, it = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r.changed_slots for r in leaks.reparameterised(df, it).collect()}
    assert got == {(d, i): 8 for d in (1, 2) for i in range(12) if (d, i) != (2, 3)}
    assert [tuple(x) for x in leaks.leaked_passages(df, it).collect()] == [(2, 3)]


def test_templates_equal_brute_force(spark):
    """Items of one template, of nothing but names and numbers, and of both, against every pair; each slot has a value of its own."""
    r = random.Random(12)
    literals = [w for w in WORDS if w not in leaks.UNITS]
    values = iter(r.sample(range(1000, 99999), 5000))
    name = lambda: "Q" + "".join(chr(97 + int(c)) for c in str(next(values)))
    fresh = lambda shape: [name() if w == "N" else str(next(values)) if w == "1" else w for w in shape]
    pick = lambda n, kinds: [r.choice(literals) if k == "w" else k for k in r.choices(kinds, k=n)]
    shapes = [pick(30, "wN1w")] * 6 + [["N"] * 26, pick(24, "N1")] + [pick(14, "wwN") + ["N"] * 14, pick(9, "N") + pick(20, "wN") + pick(9, "1N")]
    items = [(i, fresh(x)) for i, x in enumerate(shapes)] + [(99, literals)]
    bodies = []
    for d in range(24):
        own = fresh(shapes[5 + d % 5])
        n = r.randint(17, len(own))
        a = r.randint(0, len(own) - n)
        bodies.append(edited(r, own[a : a + n], r.randint(0, 4)))
    lower = {w for _, x in items for w in x if w.isalpha() and w.islower()}
    typed = lambda ws: ["1" if w.isdigit() else "2" if w in leaks.UNITS else w if w in lower else "N" for w in ws]
    pad = ["the"] * 8
    want = {(d, i) for d, b in enumerate(bodies) for i, x in items if brute_runs(typed(pad + b + pad), typed(x))}
    docs = [(d, " ".join(["the"] * r.randint(8, 300) + b + ["the"] * 300)) for d, b in enumerate(bodies)]
    df, it = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(i, " ".join(x)) for i, x in items], "item_id bigint, text string")
    assert {(x.doc_id, x.item_id) for x in leaks.leaks(df, it).collect()} == want
    assert 40 < len(want) < 200 and {i for _, i in want} >= set(range(10))


def test_foreign_text_meets_lists_of_names(spark):
    """A long text of words no item has against items of names alone: all have its template, whatever their number."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("aeioulmnrst") for _ in range(7))
    items = [(i, " ".join(word().title() for _ in range(30))) for i in range(20)]
    df = spark.createDataFrame([(1, " ".join(word() for _ in range(2000)))], "doc_id bigint, text string")
    it = spark.createDataFrame(items, "item_id bigint, text string")
    assert sorted(map(tuple, leaks.reparameterised(df, it).collect())) == [(1, i, 30) for i in range(20)]


def test_runs_kernel_counts_edits():
    a = np.arange(30)
    b = np.concatenate([a[:10], [99], a[11:20], a[21:]])
    doc = np.full((1, 30 + leaks.BAND - 1), 77)
    doc[0, 8 : 8 + len(b)] = b
    r = leaks.longest_runs(doc, a[None, :], np.array([30]))[:, 0]
    assert r[0] == 10 and r[2] == 30


GIVEN, FAMILY = {"elin", "glaiño", "torind", "seloë", "marin", "corind"}, {"farenberg", "joriquist", "coruloløv", "halberg", "toriquist"}


@pytest.fixture(scope="module")
def finder():
    return pii.Finder(GIVEN, FAMILY)


def found(finder, text):
    return [(text[a:b], k) for a, b, k in finder.find(text)]


EMAILS = ["a.b+c@mail.north.example", "tower_x6&#64;example.net", "x1@inbox.test", "guild[at]example.org", "ororx (at) mail (dot) north (dot) example", "pelaer AT mail DOT north DOT example", "IST＠INBOX.TEST", "ｘｙ@example.com", "q\u200bx@example.org"]


@pytest.mark.parametrize("e", EMAILS)
def test_emails(finder, e):
    for around in ("mail me: {}", "[mailto:{} Write]", "<!-- {} -->", "--{}.", "{}", "<{}>, then"):
        assert found(finder, around.format(e)) == [(e, "email")], around


@pytest.mark.parametrize("at", ["( at )", "[ at ]", "{  AT }", "<at >", "(\tat\n)"])
def test_emails_with_space_inside_the_brackets(finder, at):
    for e in (f"john {at} mail.example", f"john{at}mail.example"):
        assert found(finder, f"mail me: {e}, now") == [(e, "email")]


PHONES = ["+1 202 555 0136", "(718) 555-0178", "+1-415-555-0155", "202.555.0175", "12025550140", "07700 900 822", "01632 960 689", "01632 960916", "+44 (0)20 7946 0416", "+44 7700 900938", "+49 30 23125 285", "030/23125858", "0 30 - 231 25 097", "555-0148", "０１６３２ ９６０９３２", "five five five zero one four eight"]


@pytest.mark.parametrize("p", PHONES)
def test_phones(finder, p):
    for around in ("call on {} at night", "| tel = {}\n| mail", "|| {} || 12", "{}", "{} (office)"):
        assert found(finder, around.format(p)) == [(p, "phone")], around


def test_spelled_digits(finder):
    t = "call two oh two five five five oh one seven five now"
    assert found(finder, t) == [("two oh two five five five oh one seven five", "phone")]
    t = "dial one two oh two five five five oh one four double two today"
    n = pii.Normal(t, spelled=True)
    assert n.text == "dial 1 2 0 2 5 5 5 0 1 4 22 today" and t[n.source(n.text.index("22")) : n.after(n.text.index("22") + 2)] == "double two"


SPELLED = ["two oh two five five five oh one seven five", "five five five zero one four eight", "plus one two oh two five five five oh one two three", "+one two oh two five five five oh one two three", "two-oh-two-five-five-five-oh-one-seven-five", "Two oh two, five five five,\noh one seven five", "t\u200bwo&nbsp;oh two five five five oh one seven five", "oh seven seven double oh nine double oh eight double two", "triple five zero one four eight"]


@pytest.mark.parametrize("p", SPELLED)
def test_spelled_phones(finder, p):
    for around in ("call on {} at night", "| tel = {}\n| mail", "{}", "{} (office), {}"):
        assert found(finder, around.format(p, p)) == [(p, "phone")] * around.count("{}"), around
        assert finder.mask(around.format(p, p)) == around.format("[PHONE]", "[PHONE]"), around


def test_spelled_phones_in_every_dress(finder):
    uk = "zero two zero seven nine four six zero nine five eight"
    for p in (uk, uk.replace(" ", "-"), uk.replace(" ", ", "), uk.replace(" ", "\n"), uk.upper(), "plus four four two zero seven nine four six zero nine five eight", "two one two five five five zero one two three", "five five five dash two three four five", "zero two zero dash seven nine four six dash zero nine five eight", "double five five zero one four eight"):
        for around in ("Call {} now", "{}", "x" * 5000 + " {} " + "y" * 5000, "phone:{}."):
            assert found(finder, around.format(p)) == [(p, "phone")], (p, around[:20])


@pytest.mark.parametrize("i", ["nine nine two two seven nine one one nine", "zero four two oh five seven seven seven two two seven E", "NZ six nine three four seven eight one three nine", "QR six zero three seven zero four C"])
def test_spelled_identities(finder, i):
    for around in ("with id# {}, then", "national insurance no. {} -->", "passport number {}"):
        assert found(finder, around.format(i)) == [(i, "identity_no")], around


def test_spelled_neighbours_and_decoys(finder):
    a, b = SPELLED[0], "four one five five five five oh one five five"
    assert found(finder, f"{a}, {b}") == [(a, "phone"), (b, "phone")]
    for t in ("one two three four five six seven eight nine", "one, two, three, four and five six", "the stone nine two three"):
        assert finder.find(t) == []


IDS = ["04 2057 77227 E", "83970077036", "992-27-9119", "763.602.764-44", "NZ-6934-7813-9", "QR603704C"]


@pytest.mark.parametrize("i", IDS)
def test_identities(finder, i):
    for around in ("with id# {}, then", "my national id {} was", "national insurance no. {} -->", "passport number {}", "identity number: {}.", "ID no. {}, x", "identity card {}"):
        assert found(finder, around.format(i)) == [(i, "identity_no")], around


def test_nothing_is_cut_off_by_a_window(finder):
    """However far what belongs to a place reaches."""
    local, labels = "a1" * 300, ".".join(["north"] * 200)
    spread = {f"{local}@{labels}.example": "email", f"{local} [at] {labels} (dot) example": "email", f"{local} at {' dot '.join(['north'] * 100)} dot example": "email"}
    spread |= {"Elin " + "A. " * 40 + "Farenberg": "person_name", "E. " * 60 + "Farenberg": "person_name", "Farenberg, Elin" + " A." * 60: "person_name"}
    spread |= {"12 " + "Oum" * 80 + " " + "Elm" * 80 + " Street": "street_address", "Am-" * 60 + "Hofstraße 12": "street_address", "Oro" * 60 + " Sokak No: 203": "street_address"}
    for text, kind in spread.items():
        assert found(finder, f"Then: {text}; and") == [(text, kind)], text[:30]
    assert found(finder, "passport" + " " * 300 + "number:" + " " * 300 + "QR603704C.") == [("QR603704C", "identity_no")]
    assert found(finder, "Dr." + " " * 300 + "Elin Farenberg") == [("Elin Farenberg", "person_name")]


def test_pathological_texts_end(finder):
    for t in ("a@" * 30_000, "1 " * 50_000, "a." * 50_000, "one " * 20_000, "Elin " * 20_000, "[at]" * 20_000, "x at y dot " * 10_000, "-a" * 50_000 + " Farenberg", "12 a " * 20_000 + "Street"):
        finder.find(t)
    many = " ".join(f"u{k}@a.example" for k in range(20_000))
    assert len(finder.find(many)) == 20_000


ADDRESSES = ["3A Barostad Street", "Flat 8, 89 Coriora Close", "36 Rosenlunaford Road, Apt 18", "Calle Noriyarestad 206", "92 rue de Elenmere", "239 rue Kelo", "Rosenlunaford Sokak No: 203", "Quiloliumgasse 107", "Seleraeholmstraße 27", "Zelolestadweg 215", "212 verizelinora ave", "5 OROUM LANE", "4512 Oroum Lane", "60351 Oak Avenue, Apt 9"]


@pytest.mark.parametrize("a", ADDRESSES)
def test_addresses(finder, a):
    for around in ("then living at {}.", "Headquarters: {}, Ulomere.", "|| {} ||", ": {}\n", "lives at {} and everyone"):
        assert found(finder, around.format(a)) == [(a, "street_address")], around


NAMES = ["Elin Farenberg", "Elin R. Farenberg", "Farenberg, Elin", "Glaiño Joriquist-Halberg", "SELOË CORULOLØV", "elin farenberg", "E. Farenberg"]


@pytest.mark.parametrize("n", NAMES)
def test_names(finder, n):
    for around in ("--{} 12:01, 4 May", "'''{}''' (born 1900", "[[de:{}]]", "| {} || x", "Ask for {}, now", "With {} they", "Mrs. {} was", "Prof. {}"):
        assert found(finder, around.format(n)) == [(n, "person_name")], around


def test_unlisted_names_need_a_title(finder):
    assert found(finder, "Mr. Oromarin Saliquist came; see [[Oromarin Saliquist]].") == [("Oromarin Saliquist", "person_name")] * 2
    assert found(finder, "Oromarin Saliquist came") == []


def test_years_before_streets(finder):
    assert found(finder, "They live at 1600 Oak Avenue now") == [("1600 Oak Avenue", "street_address")]
    for t in ("In 1895 Oak Street was paved.", "since 1871 Farael Terrace", "On 4 May 1900 Oak Avenue was closed", "held 4512 oak avenue trees"):
        assert finder.find(t) == []


DECOYS = ["See build lib@5.13.2 and the tag @amber.", "{{mention|user@wiki}} on 2006-06-12.", "ISBN 978-0-00-870017-2, pp. 208–821.", "Coordinates: 53.7485, -62.4298; 3 253 787 tonnes.", "The score was 12-12-855 by the rules.", "Inventory no. 5890/82, sheet 119-33.", "Wenodale Street was paved in 1895; 8 tram lines used it.", "Mount Farenberg and Lake Halberg; the Farenberg Bridge.", "held 7 towers at a cost of 12 crowns", "foundry [[at]] Barudaludale held 172", "'''6746 Farael terrace''' is a minor body", "https://a.example/339 |access-date=2008-05-14", "", None, " ", "x" * 100_000]


@pytest.mark.parametrize("t", DECOYS)
def test_decoys(finder, t):
    assert finder.find(t) == []


def test_tables(spark):
    rows = [(1, "Mail a&#64;b.example, ask Elin Farenberg.", 0, "k"), (2, None, 0, "k"), (3, "", 0, "k"), (1, "Mail a&#64;b.example, ask Elin Farenberg.", 0, "k"), (None, "x@y.example", 0, "k"), (4, "İstanbul: Elin Farenberg", 0, "k")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, start_pos int, kind string")
    names = spark.createDataFrame([("Elin", "given"), ("Farenberg", "family"), (None, "given"), ("", "family"), ("X", None)], "name string, kind string")
    got = sorted((r.doc_id or 0, r.start_pos, r.end_pos, r.kind) for r in pii.personal_places(df, names).collect())
    assert got == [(0, 0, 11, "email"), *[(1, 5, 20, "email")] * 2, *[(1, 26, 40, "person_name")] * 2, (4, 10, 24, "person_name")]
    masked = {r.doc_id: r.text for r in pii.mask_personal(df, names).collect()}
    assert masked == {1: "Mail [EMAIL], ask [PERSON_NAME].", 2: None, 3: "", None: "[EMAIL]", 4: "İstanbul: [PERSON_NAME]"}
    assert pii.personal_places(df.limit(0), names).count() == 0
    assert pii.personal_places(df, names.limit(0)).count() == 3
