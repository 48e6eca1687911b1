"""Mentions of several tokens, and entities by shape."""

from docloom.llm import pii

SEEN = ["call +1 (974) 555-3436 now", "mail und.34@mail7.example.com please", "from 97.51.17.173 and 12 of 300", "pay 4111111111111111 in 2024", "on 2024-01-15 at 10 20 30 of 1,200"] * 20


def found(text):
    return [(pii.KINDS[k], text[a:b]) for k, a, b in pii.train(SEEN).spans(text)]


def test_mentions_of_several_tokens_are_linked():
    text = "call +1 (555) 123-4567 now" + " or later" * 200
    for again in ("5551234567", "(555) 123-4567", "555 123 4567", "1 555 123 4567"):
        assert found(f"{text} {again}, in 2024") == [("phone", "+1 (555) 123-4567"), ("phone", again)], again
    assert found(f"{text} 2024 555 123 4567 12 we") == [("phone", "+1 (555) 123-4567"), ("phone", "555 123 4567")]
    assert found("pay 4111111111111111 or 4111.1111.1111.1111 now") == [("card", "4111111111111111"), ("card", "4111.1111.1111.1111")]


def test_entities_by_shape_alone():
    for phone in ("(415) 555-0100", "415-555-0100"):
        assert found(f"ring {phone} or, later, {phone}.") == [("phone", phone)] * 2
    for clean in ("in 2024 there were 12 of 300 and 19745553436 more", "2024-01-15 to 2024-02-15", "10 20 30 40 50 60 70 80 90 100 110", "1,200 of 3,400 in 12.5", "pages 100-200 of 978-3-16-148410-0"):
        assert found(clean) == [], clean


def test_one_long_token_takes_linear_time():
    import random
    import time

    rnd = random.Random(1)
    field = pii.train(["call +1 555 123 4567 or a@b.co"] * 20)
    say = {"letters": "x" * 4_000_000, "cjk": "".join(map(chr, rnd.choices(range(0x4E00, 0x5600), k=1_300_000))), "digits": "1" * 2_000_000, "groups": "123 4567 " * 200_000, "dots": "1." * 500_000, "signs": "@" * 300_000 + "+1(" * 300_000}
    for name, text in say.items():
        began = time.perf_counter()
        field.spans("a@b.co " + text)
        assert time.perf_counter() - began < 30, name


def mention(rnd):
    """A phone or card as the base patterns see it, and as they don't."""
    if rnd.random() < 0.5:
        a, b, c = rnd.randrange(200, 999), rnd.randrange(200, 999), rnd.randrange(1000, 9999)
        return "phone", f"+1 ({a}) {b}-{c}", rnd.choice([f"{a}{b}{c}", f"({a}) {b}-{c}", f"{a}.{b}.{c}", f"1{a}{b}{c}"])
    digits = [rnd.randrange(1, 9)] + [rnd.randrange(10) for _ in range(14)]
    last = next(d for d in range(10) if pii.luhn("".join(map(str, [*digits, d]))))
    card = "".join(map(str, [*digits, last]))
    return "card", card, rnd.choice([".".join(card[k : k + 4] for k in range(0, 16, 4)), f"({card[:4]}) {card[4:8]} {card[8:12]} {card[12:]}"])


def document(rnd):
    """Text with mentions, second mentions and numbers that are neither; the spans that a reader would add."""
    out, want = [], []
    kept = [mention(rnd) for _ in range(rnd.choice([0, 1, 1, 2]))]
    pieces = [(None, x) for x in (f"order {rnd.randrange(10**6)}", f"in {rnd.randrange(1900, 2030)}", f"{rnd.randrange(10)}.{rnd.randrange(100)}", f"id{rnd.randrange(10**9)}", f"{rnd.randrange(10**8, 10**9)}", "plain words") if rnd.random() < 0.7]
    pieces += [(None, base) for _, base, _ in kept] + [(kind, other) for kind, _, other in kept for _ in range(rnd.choice([1, 2]))]
    rnd.shuffle(pieces)
    for kind, x in pieces:
        at = sum(map(len, out))
        out.append(x)
        if kind:
            want.append((pii.KINDS.index(kind), at, at + len(x)))
        out.append(rnd.choice([", then ", " and the word ", "; so "]))
    return "".join(out), set(want)


def test_held_out_precision_and_recall_of_added_spans():
    import random

    rnd = random.Random(5)
    field = pii.train([document(rnd)[0] for _ in range(300)])
    alone = pii.Field(field.unary, field.chain, field.skip * 0, field.threshold)
    hit = {True: 0, False: 0}
    added = {True: 0, False: 0}
    total = 0
    for _ in range(400):
        text, want = document(rnd)
        base = set(pii.base_spans(text))
        want -= base
        total += len(want)
        for skip, f in ((True, field), (False, alone)):
            got = set(f.spans(text)) - base
            hit[skip] += len(got & want)
            added[skip] += len(got)
    print("precision", hit[True] / added[True], "recall", hit[True] / total, "without skip edges", hit[False] / max(1, added[False]), hit[False] / total)
    assert hit[True] >= 0.95 * added[True] and hit[True] >= 0.8 * total
    assert hit[False] < hit[True] - 0.1 * total


def test_skip_edges_decide_on_the_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    field = pii.train_on(docs)
    rows = lambda f: {(r["doc_id"], r["spans"]) for r in pii.find_personal_data(docs, f).collect()}
    assert rows(field) != rows(pii.Field(field.unary, field.chain, field.skip * 0, field.threshold))
