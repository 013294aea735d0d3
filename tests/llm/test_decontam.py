import random
import re

from kestrel.llm.decontam import LITERALS, OUTER, SHARE, SURFACE_WORDS, UNITS, WINDOW, clean_documents, contaminated, item_classes

PUNCT = OUTER.decode()


def template(text):
    """(canonical word, surface) of each word, word by word."""
    out, opens, number = [], True, False
    for line in (text or "").split("\n"):
        opens = True
        for raw in re.findall("[^\x20\x09-\x0D]+", line):
            word, starts = raw.strip(PUNCT), opens
            opens = raw[-1] in ".!?"
            if not word:
                continue
            low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in word)
            if re.search("[0-9]", word):
                out.append(("<number>", low))
                number = True
                continue
            if number and low in UNITS:
                out.append(("<unit>", low))
            elif not starts and "A" <= word[0] <= "Z" and sum("A" <= c <= "Z" for c in word) == 1:
                out.append(("<name>", low))
            else:
                out.append((low, low))
            number = False
    return out


def runs(words, size):
    for i in range(len(words) - size + 1):
        w = words[i:i + size]
        if sum(c[0] != "<" or c == low for c, low in w) >= min(LITERALS, size):
            yield i, tuple(c for c, _ in w), [low for c, low in w if c != low]


def surfaces(words, size):
    for i in range(len(words) - size + 1):
        yield i, tuple(low for _, low in words[i:i + size]), []


def brute(docs, items):
    out = set()
    for item, text in dict(items).items():
        words = template(text)
        size = min(len(words), WINDOW)
        own = list(runs(words, size)) if len(words) >= LITERALS else []
        plain = not own and len(words) >= SURFACE_WORDS  # no template: word for word
        if plain:
            own = list(surfaces(words, size))
        index = {}
        for i, key, slots in own:
            index.setdefault(key, []).append((i, slots))
        for doc in {d for d, _ in docs}:
            found, values = set(), {}
            for d, t in docs:
                if d != doc or not own:
                    continue
                for _, key, slots in (surfaces if plain else runs)(template(t), size):
                    for i, item_slots in index.get(key, ()):
                        found.add(i)
                        for a, b in zip(item_slots, slots):
                            values.setdefault(a, set()).add(b)
            share = round(sum(len(v) == 1 for v in values.values()) / len(values), 6) if values else 1.0
            if own and len(found) >= SHARE * len(own) and share >= SHARE:
                out.add((doc, item, len(found), len(own), len(values), share))
    return out


ITEMS = [
    (0, "If Tom has 12 apples and gives Mary 5 apples, how many apples does Tom keep for the long day?"),
    (1, "A train moves 60 km in 2 hours at a steady speed; find the speed of this train."),
    (2, "short item of six words only"), (3, "three words only"), (4, None), (5, ""), (6, "1 2 3 4 5 6 7 8 9 10 11 12"),
    (7, "every word of this plain passage stays as it is and none of it is a slot at all in any way"),
]


def test_equals_brute_force(docs_of, shared):
    rnd = random.Random(2)
    filler = lambda n: " ".join(rnd.choice(["the", "of", "Mary", "7", "km", "apples", "speed", "x."]) for _ in range(n))
    rows = [(i, filler(rnd.randrange(80))) for i in range(30)]
    rows += [(100, filler(20) + "\n" + ITEMS[0][1] + " " + filler(9)),
             (101, filler(5) + ".\nIf Anna has 31 apples and gives Bob 9 apples, how many apples does Anna keep for the long day?"),
             (102, "If Anna has 31 apples and gives Bob 9 apples, how many apples does Carl keep for the long day?"),
             (103, "We know: a train moves 90 miles in 3 hours at a steady speed; find the speed of this train!"),
             (104, "SHORT item of, six words (only)"), (105, "1 2 3 4 5 6 7 8 9 10 11 12"), (106, None), (107, ""), (None, ITEMS[7][1]),
             (108, " ".join(ITEMS[7][1].split()[:9])), (109, "word " * 50000 + ITEMS[7][1]), (110, "***every*** word of this PLAIN passage stays as it is, and none of it is a slot at all in any way")]
    rows += [rows[30], rows[30]]
    bench = shared.createDataFrame([(i, t, "x") for i, t in ITEMS + ITEMS[:2]], "item_id bigint, text string, doc_id string")
    got = {tuple(r) for r in contaminated(docs_of(rows), bench).collect()}
    want = brute(rows, ITEMS)
    assert got == want
    assert {(100, 0), (101, 0), (103, 1), (104, 2), (None, 7), (109, 7), (110, 7)} <= {g[:2] for g in got}
    assert (105, 6) in {g[:2] for g in got}  # numbers only: found word for word
    assert not {102, 108} & {g[0] for g in got} - {102}
    kept = clean_documents(docs_of(rows), bench)
    bad = {w[0] for w in want}
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, _ in rows if i not in bad)
    assert kept.columns == docs_of(rows).columns
    assert contaminated(docs_of([]).limit(0), bench).count() == 0
    assert contaminated(docs_of(rows), bench.limit(0)).count() == 0


def test_each_occurrence_and_each_text_counts_alone(docs_of, shared):
    question = "If Tom has {} apples and gives Mary {} apples, how many apples does Tom keep for the long day?"
    own, other, third = question.format(12, 5), question.format(31, 9).replace("Tom", "Anna").replace("Mary", "Bob"), question.format(7, 2).replace("Tom", "Carl").replace("Mary", "Eve")
    half = own.split()
    rows = [(1, f"{own}\n{other}"), (2, f"{other} so it is. {third} {other}"), (3, f"It is so.\n{other}\n" + own.replace("apples and", "apples today and") + f" {third}"),
            (4, " ".join(half[:9])), (4, " ".join(half[-9:])), (5, own), (5, "a clean text"), (None, own), (None, "a clean text"), (None, third), (6, None), (7, " ".join(half[:9]))]
    items = [(0, own), (0, ITEMS[7][1]), (None, ITEMS[1][1])]
    rows += [(8, ITEMS[7][1]), (9, ITEMS[1][1])]
    bench = shared.createDataFrame(items, "item_id bigint, text string")
    got = sorted(((r.doc_id, r.item_id, r.slot_share) for r in contaminated(docs_of(rows), bench).collect()), key=str)
    assert got == sorted([(1, 0, 1.0), (2, 0, 1.0), (3, 0, 1.0), (5, 0, 1.0), (None, 0, 1.0), (None, 0, 1.0), (8, 0, 1.0), (9, None, 1.0)], key=str)
    kept = sorted(((r.doc_id, r.text) for r in clean_documents(docs_of(rows), bench).collect()), key=str)
    assert kept == sorted([r for r in rows if r[0] in (4, 6, 7) or r[1] == "a clean text"], key=str)


def test_names_that_open_sentences_and_copies_in_other_case(docs_of, shared):
    apples = "Tom buys 5 apples. Tom eats 2 of them. How many apples does Tom have left?"
    rich = "Yesterday Mary met Bob and then she asked Alice for the old book of Carl, so Mary and Bob went to Alice again with Carl by noon."
    variant = apples.replace("Tom", "Sam").replace("5", "9")
    rows = [(1, variant), (2, variant.replace(" ", "\n")), (3, rich.lower()), (4, rich.replace(" ", "\n")), (5, rich.upper()), (6, rich.title()),
            (7, rich.replace("Mary", "Eve").replace("Bob", "Jim").replace(" ", " \n")), (8, apples.lower()), (9, rich),
            (20, "Tom sells 5 pears. Tom keeps 2 of them. How many plums does Tom have now?")]
    bench = shared.createDataFrame([(0, apples), (1, rich)], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id, r.windows <= r.item_windows) for r in contaminated(docs_of(rows), bench).collect()}
    assert got == {(1, 0, True), (2, 0, True), (8, 0, True), *[(i, 1, True) for i in (3, 4, 5, 6, 7, 9)]}


def test_items_without_a_template_match_word_for_word(docs_of, shared):
    items = [(0, "What is 17 + 25?"), (1, "Compute 12 * 34 - 56 / 7 + 89."), (2, "Who wrote Hamlet?"), (3, "Yes."), (4, ITEMS[1][1])]
    rows = [(1, "Exam. What is 17 + 25? Write it."), (2, "what is 17 + 26?"), (3, "compute 12 * 34 - 56 / 7 + 89"), (4, "Compute 12 * 34 - 56 / 7 + 88, or less"),
            (5, "who WROTE hamlet, and when"), (6, "Who wrote Macbeth?"), (7, "Yes. And yes."), (8, ITEMS[1][1].replace("60", "75")), (9, "17 25 what is")]
    bench = shared.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in contaminated(docs_of(rows), bench).collect()}
    assert got == {(1, 0), (3, 1), (5, 2), (8, 4)} == {b[:2] for b in brute(rows, items)}


def test_runs_of_names_are_one_name(docs_of, shared):
    apples = "Then Tom buys 5 apples and later Tom eats 2 of them, so how many apples does Tom have left?"
    duo = "At noon Ann Lee met Bob Ray near the old mill and gave Bob Ray all of the 12 letters that Ann Lee wrote to him."
    rows = [(1, apples.replace("Tom", "Maria Lopez")), (2, apples.replace("Tom", "Maria de Lopez")), (3, duo.replace("Ann Lee", "Eve").replace("Bob Ray", "Carl Otto Haas")),
            (4, apples.replace("Tom", "Maria, Lopez,")), (5, "In June Maria Lopez and Carl Otto Haas went home."),
            (6, "Then Ann Bee buys 5 apples and later Carl Dow eats 2 of them, so how many apples does Eve Fox have left?")]
    bench = shared.createDataFrame([(0, apples), (1, duo)], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r.slot_share for r in contaminated(docs_of(rows), bench).collect()}
    assert {(1, 0), (3, 1)} <= set(got) and not {5} & {d for d, _ in got}


def test_items_of_one_template_are_a_class(docs_of, shared):
    names = [f"{a}{b}" for a in ("Al", "Bo", "Cy", "Di") for b in ("an", "el", "is", "or", "ud")]
    ask = "When {} has {} red apples and then sells {} of them, how many red apples does {} still have?"
    rnd = random.Random(3)
    fill = lambda i: ask.format(names[i % 20], rnd.randrange(100, 900), rnd.randrange(10, 99), names[i % 20])
    items = [(i, fill(i)) for i in range(60)] + [(100, ITEMS[1][1]), (101, ask.format("Tom", 7, 7, "Tom"))]
    rows = [(i, f"So it is. {fill(7 * i)}") for i in range(60)] + [(500, ITEMS[1][1])]
    bench = shared.createDataFrame(items, "item_id bigint, text string")
    got = contaminated(docs_of(rows), bench, links=True).collect()
    big = [r for r in got if r.item_id == 0]
    assert sorted(r.doc_id for r in big) == list(range(60)) and all(r.n_items == 60 and r.windows == r.item_windows and r.slot_share == 1.0 for r in big)
    assert {(r.doc_id, r.n_items) for r in got if r.item_id == 100} == {(500, 1)}
    assert len(got) <= 2 * len(rows)  # the item whose two numbers are one value is a class of its own
    assert {(r.item_id, r.class_item_id, r.n_items) for r in item_classes(bench).collect()} == {*[(i, 0, 60) for i in range(60)], (100, 100, 1), (101, 101, 1)}
    assert item_classes(bench.limit(0)).count() == 0
