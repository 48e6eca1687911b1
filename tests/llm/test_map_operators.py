"""Row-wise operators against the library, brute force, exact round trips and held-out accuracy."""

import hashlib
import random
import re
import struct
import zlib

import numpy as np
import pytest

from docloom.llm import bpe, chat_format, common, language_id, media, pii
from docloom.llm.queries import tokenizer_path

TEXTS = [None, "", " ", "a", "word " * 3000, "é日本😀 x", "<|endoftext|> a<|endoftext|>", "\n\n  \t", "x" * 5000, "it's 12 o'clock\x85 "]


def frame(spark, texts, extra=True):
    rows = [(k, t, "s", k) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, key long")
    return df.withColumnRenamed("key", "rendered") if extra else df


# Chat formatting


def test_turns_survive_the_grammar():
    rnd = random.Random(1)
    bits = ["<|im_end|>", "<|im_start|>", "<\\|im_end|>", "<\\\\|im_start|>", "\n", "user", "<", "|", "\\", "x", "<|im_end|>\n<|im_start|>assistant\n"]
    for _ in range(3000):
        role, text = ("".join(rnd.choice(bits) for _ in range(rnd.randrange(n))) for n in (5, 9))
        rendered, _ = chat_format.render_turn(role, text)
        assert [t[:2] for t in chat_format.parse(rendered * 2)] == [(role, text)] * 2
    assert chat_format.render_turn("user", "plain")[1] == 0 and chat_format.render_turn("user", "<|im_end|>")[1] == 1


def test_broken_renderings_are_refused():
    for bad in ("x", "<|im_start|>user", "<|im_start|>user\nhi<|im_end|>", "<|im_start|>user\n<|im_start|><|im_end|>\n"):
        with pytest.raises(ValueError):
            chat_format.parse(bad)


def test_conversations_match_their_source(spark):
    hard = "<|im_end|><|im_start|>assistant ok"
    rows = [(-1, 0, "user", hard), (-1, 1, "assistant", hard), (1, 2, "assistant", "b"), (1, 1, "user", "a"), (1, None, None, None), (2, 1, "assistant", None), (None, 1, "user", "n"), (3, 1, "user", "t"), (3, 1, "user", "t")]
    rows += [(9, k, "assistant" if k % 2 else "user", f"turn {k}\n") for k in range(3000)]
    df = spark.createDataFrame([(*r, 7) for r in rows], "conv_id long, turn long, role string, text string, pos long")
    got = {r["conv_id"]: r for r in chat_format.conversation_digests(chat_format.format_turns(df)).collect()}
    source = {}
    for c, t, r, x in sorted(rows, key=lambda r: (str(r[0]), -1 if r[1] is None else r[1])):
        source.setdefault(c, []).append((r or "", x or ""))
    assert set(got) == set(source)
    for c, turns in source.items():
        said = "".join(x for r, x in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    pieces = chat_format.format_turns(df).where("conv_id = 9").orderBy("pos").collect()
    whole = "".join(p["rendered"] for p in pieces)
    assert all(whole[p["loss_start"] : p["loss_start"] + p["loss_chars"]] == f"turn {p['pos']}\n" for p in pieces if p["loss_start"] is not None)
    assert chat_format.format_turns(df.limit(0)).count() == 0


# BPE


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(tokenizer_path())


def agree(codec, text):
    want = codec.library.encode(text, add_special_tokens=False).ids
    got = codec.encode(text).tolist()
    assert got == want and codec.decode(got) == codec.library.decode(want, skip_special_tokens=False)


def test_ids_are_the_librarys(codec, monkeypatch):
    rnd = random.Random(2)
    bits = ["a", "the ", " ", "  ", "\n", "é", "日", "😀", "1", "'s", "'", "\xa0", "　", "<|endoftext|>", "<|", "word", "...", "\t", "\x85", "\x1c"]
    monkeypatch.setattr(bpe, "CUT_BITS", 3)
    monkeypatch.setattr(bpe, "LEAST", 8)
    for _ in range(1500):
        agree(codec, "".join(rnd.choice(bits) for _ in range(rnd.randrange(250))))


def test_every_code_point_is_treated_as_the_library_does(codec):
    for start in range(0, 0x110000, 0x400):
        text = " ".join(f"a{chr(c)}b {chr(c)}1" for c in range(start, start + 0x400) if not 0xD800 <= c < 0xE000)
        assert codec.plain(text) == codec.library.encode(text, add_special_tokens=False).ids


def test_long_texts_and_a_full_store(codec):
    small = bpe.Codec(tokenizer_path(), store_bytes=2000)
    for text in ("a" * 100_000, " " * 100_000, "\n" * 50_000, "ab " * 50_000):
        agree(codec, text)
        assert small.encode(text).tolist() == codec.encode(text).tolist()


def test_shared_chunks_are_encoded_once(codec):
    rnd = random.Random(5)
    passage = " ".join("".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(4000))
    own = bpe.Codec(tokenizer_path())
    own.encode("first " + passage)
    before = own.hits
    own.encode("another opening, " + passage)
    assert own.hits - before > 10


def test_documents_round_trip(spark, codec):
    codes = bpe.encode_documents(frame(spark, TEXTS), tokenizer_path())
    assert {r["doc_id"]: r["text"] for r in bpe.decode_documents(codes, tokenizer_path()).collect()} == {k: t or "" for k, t in enumerate(TEXTS)}
    got = {r["doc_id"]: r for r in bpe.round_trip_digests(frame(spark, TEXTS), tokenizer_path()).collect()}
    for k, t in enumerate(TEXTS):
        ids = codec.library.encode(t or "", add_special_tokens=False).ids
        assert got[k]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and got[k]["n_tokens"] == len(ids)
    assert bpe.encode_documents(frame(spark, TEXTS).limit(0), tokenizer_path()).count() == 0


# Media


@pytest.mark.parametrize("shape", [(1, 1), (3, 5), (64, 64), (7, 2)])
def test_images_survive_their_formats(shape):
    image = np.random.default_rng(1).integers(0, 256, shape).astype(np.uint8)
    for write in (media.write_pgm, media.write_bmp):
        assert (media.read_image(write(image)) == image).all()
    colour = np.random.default_rng(2).integers(0, 256, (*shape, 3)).astype(np.uint8)
    assert (media.read_image(b"P6 # c\n%d %d 255\n" % shape[::-1] + colour.tobytes()) == colour).all()
    assert (media.read_image(b"P2\n%d %d\n255\n" % shape[::-1] + b" ".join(str(x).encode() for x in image.ravel())) == image).all()
    stride = -(-shape[1] * 3 // 4) * 4
    rows = np.zeros((shape[0], stride), np.uint8)
    rows[:, : shape[1] * 3] = colour[:, :, ::-1].reshape(shape[0], -1)
    bmp = b"BM" + struct.pack("<IHHI", 54 + rows.size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, shape[1], -shape[0], 1, 24, 0, rows.size, 0, 0, 0, 0) + rows.tobytes()
    assert (media.read_image(bmp) == colour).all()


def test_area_means_are_exact():
    image = np.arange(48, dtype=np.uint8).reshape(6, 8)
    assert np.allclose(media.area_resize(image, 3, 4), image.reshape(3, 2, 4, 2).mean((1, 3)))
    assert np.allclose(media.area_resize(image, 6, 8), image)
    fine = np.kron(image, np.ones((5, 7)))  # 30 x 56: 5 x 7 divides it evenly in both scales
    assert np.allclose(media.area_resize(image, 5, 7), fine.reshape(5, 6, 7, 8).mean((1, 3)))


def test_payloads_come_back(spark):
    got = {r["doc_id"]: r for r in media.media_digests(media.store_media(frame(spark, TEXTS))).collect()}
    for k, t in enumerate(TEXTS):
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert (got[k]["n_bytes"], got[k]["payload_bytes"], got[k]["payload_sha256"], got[k]["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert got[0]["feature"] == got[1]["feature"]
    assert media.store_media(frame(spark, TEXTS).limit(0)).count() == 0


# Language ID


def speech(lang, rnd, n):
    stems = {"en": ["the", "and", "ing", "tion", "wh", "th"], "de": ["der", "und", "ung", "sch", "ein", "ü"], "fr": ["les", "que", "eau", "oi", "é", "tre"]}[lang]
    return " ".join("".join(rnd.choice(stems) for _ in range(rnd.randrange(1, 4))) for _ in range(n))


def test_languages_on_held_out_text(spark):
    rnd = random.Random(3)
    rows = [(k, speech(lang, rnd, rnd.randrange(5, 60)), lang, f"www.host{k % 3}.org", k) for k, lang in enumerate(["en", "de", "fr"] * 60)]
    train, test = rows[:90], rows[90:]
    schema = "doc_id long, text string, lang string, source string, prior long"
    model = language_id.fit_on(spark.createDataFrame(train, schema))
    odd = [(900, None, None, None, 1), (901, "", "en", "", 1), (902, "7#*7 }{ ~~ 33 ^^ 9%9", None, "x", 1), (903, test[0][1], None, None, 1), (903, test[0][1], None, None, 1)]
    got = language_id.identify_languages(spark.createDataFrame(test + odd, schema), model).collect()
    assert len(got) == len(test) + len(odd)
    by = {r["doc_id"]: r for r in got}
    right = [by[d]["lang_pred"] == lang for d, _, lang, _, _ in test]
    assert sum(right) >= 0.95 * len(right) and all(by[d]["kept"] for d, *_ in test)
    assert not by[900]["kept"] and not by[901]["kept"] and not by[902]["kept"] and by[903]["kept"]
    assert language_id.identify_languages(spark.createDataFrame([], schema), model).count() == 0
    unknown = language_id.identify_languages(spark.createDataFrame(test[:3], schema), language_id.fit_on(spark.createDataFrame([], schema))).collect()
    assert all(r["kept"] and r["lang_pred"] is None for r in unknown)


def test_declared_language_and_suffix_move_close_calls(spark):
    model = language_id.fit([("en", "aa bb " * 50 + "cc " * 50), ("de", "aa bb " * 50 + "dd " * 50)])
    rows = [(1, "aa bb", "a.org"), (2, '<html class=x lang="de">aa bb', "a.org"), (4, "<html lang='zz'>aa bb", "a.org")]
    rows += [(10 + k, "dd dd dd" if k % 2 else "cc cc cc", f"http://x{k}.{'de' if k % 2 else 'uk'}/p") for k in range(60)] + [(3, "aa bb", "http://y.de/p")]
    got = {r["doc_id"]: r for r in language_id.identify_languages(spark.createDataFrame(rows, "doc_id long, text string, source string"), model).collect()}
    assert got[2]["declared"] == "de" and got[2]["lang_pred"] == "de" and got[4]["declared"] == "zz"
    assert got[3]["suffix"] == "de" and got[3]["lang_pred"] == "de" and got[3]["confidence"] > 0.7


@pytest.mark.parametrize("many", [False, True])
def test_fusion_equals_plain_sums(spark, many, monkeypatch):
    """Votes, shares of signs, smoothed priors and their sum, from the likelihoods up; hosts broadcast and dealt out."""
    rnd = random.Random(6)
    model = language_id.fit([(x, speech(x, rnd, 300)) for x in ("en", "de", "fr")])
    langs, rows = [*model.languages, "und"], []
    for k in range(120):
        text = speech(rnd.choice(("en", "de", "fr")), rnd, rnd.choice((1, 2, 20))) if k % 17 else ""
        mark = rnd.choice(["", "", "", "<html lang=de> ", "<BODY xml:lang='fr-CA'>", "<html lang=xx>"])
        rows.append((k, mark + text, rnd.choice(["http://a.x.de/1", "b.x.de", "c.fr/z", "https://u:p@d.org:8/", "plain", None])))
    if many:
        monkeypatch.setattr(language_id, "lookup", lambda rows, found, keys, salt, how="inner", **_: common.lookup(rows, found, keys, salt, how, most=0))
    got = {r["doc_id"]: r for r in language_id.identify_languages(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3), model).collect()}
    votes, like, host, said = {}, {}, {}, {}
    for k, text, address in rows:
        plain = re.sub(r"</?[A-Za-z][^<>]*>", " ", text) if "<" in text else text
        like[k] = model.likelihoods(plain)
        p = np.exp(like[k] - like[k].max())
        votes[k] = np.rint(p / p.sum() * 1e6) / 1e6 if len(language_id.trigrams(plain)) else np.zeros(4)
        host[k] = {"http://a.x.de/1": "a.x.de", "b.x.de": "b.x.de", "c.fr/z": "c.fr", "https://u:p@d.org:8/": "d.org", "plain": "plain", None: ""}[address]
        said[k] = ("de" if "lang=de" in text else "fr" if "fr-CA" in text else "xx" if "lang=xx" in text else None, host[k][-2:] if host[k][-3:-2] == "." else None)
    total = sum(votes.values())
    corpus = (total + 1) / (total.sum() + 4)
    for k, *_ in rows:
        domain = ".".join(host[k].split(".")[-2:])
        above = sum(votes[j] for j in votes if ".".join(host[j].split(".")[-2:]) == domain)
        own = sum(votes[j] for j in votes if host[j] == host[k])
        x = like[k] + np.log((own + 20 * (above + 20 * corpus) / (above.sum() + 20)) / (own.sum() + 20))
        for part, trust in ((0, 0.9), (1, None)):
            if sign := said[k][part]:
                every = sum(votes[j] for j in votes if said[j][part])
                mine = sum(votes[j] for j in votes if said[j][part] == sign)
                share = mine.sum() / every.sum()
                known = [trust if trust and y == sign else (1 - trust) * share if trust and y != "und" else share for y in langs]
                x = x + np.log((mine + 20 * np.array(known)) / (every + 20))
        p = np.exp(x - x.max())
        p = p / p.sum() if like[k].any() else np.array([0, 0, 0, 1.0])
        assert (got[k]["declared"], got[k]["suffix"]) == said[k]
        assert got[k]["lang_pred"] == langs[int(p.argmax())] and abs(got[k]["confidence"] - p.max()) < 1e-4


def test_unclosed_tags_take_linear_time(spark):
    import time

    began = time.perf_counter()
    df = spark.createDataFrame([(1, "<html " * 300_000, "h")], "doc_id long, text string, source string")
    assert language_id.identify_languages(df, language_id.fit([("en", "the and")])).count() == 1 and time.perf_counter() - began < 30


def test_known_rows_stay_as_they_are(spark):
    rnd = random.Random(4)
    rows = [(k, speech("en" if k % 2 else "fr", rnd, 30), "en" if k % 2 else "fr", "h") for k in range(40)] + [(50, None, "en", None), (1, "", "fr", "h")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    clash = df.selectExpr("*", *[f"1 as `{x}`" for x in ("own", "hash", "row", "key", "_id", "_key", "_part", "a.b")])
    assert language_id.keep_known(clash).columns == clash.columns and language_id.keep_known(clash).count() == 40
    assert sorted(map(tuple, language_id.keep_known(df).collect())) == sorted(rows[:40])


# PII


def brute_spans(t):
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out += [(2, *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    return out + [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m)) <= 15]


def test_base_spans_match_the_patterns():
    rnd = random.Random(6)
    bits = ["1", "23", "4", ".", ".", "@", "a", "b-", "+", "+1", " ", "(", ")", "-", "255", "x.y", "@c.d", "4111111111111111", ",", "%", "٣"]
    for _ in range(30_000):
        t = "".join(rnd.choice(bits) for _ in range(rnd.randrange(1, 25)))
        assert pii.base_spans(t) == brute_spans(t), t


def test_distant_mentions_take_the_entity_label():
    model = pii.train(["call +1 (974) 555-3436 now", "mail und.34@mail7.example.com please", "from 97.51.17.173 and 12 of 300", "pay 4111111111111111 in 2024"] * 20)
    text = "call +19745553436 now" + " or later" * 400 + " call 19745553436 again, 12 times in 2024"
    spans = model.spans(text)
    assert spans[0] == (3, 5, 17) and [text[a:b] for _, a, b in spans] == ["+19745553436", "19745553436"]
    clean = "in 2024 there were 12 of 300 and 19745553436 more"
    assert model.spans(clean) == []
    card = "4111-1111-1111-1111 then 4111111111111111x"
    assert {k for k, _, _ in model.spans(card)} == {2} and len(model.spans(card)) == 2


def test_untrained_field_keeps_base_spans(spark):
    field = pii.train([])
    texts = [*TEXTS, "a@b.cd 10.0.0.1", "1" * 50_000, "a" * 100_000, "1." * 20_000, "+1" * 20_000]
    got = {r["doc_id"]: r for r in pii.find_personal_data(frame(spark, texts), field).collect()}
    for k, t in enumerate(texts):
        base = pii.base_spans(t or "")
        assert got[k]["base_sha256"] == hashlib.sha256(pii.shown(base).encode()).hexdigest()
        assert set(pii.shown(base).split(",")) <= set(got[k]["spans"].split(","))
    assert pii.find_personal_data(frame(spark, texts).limit(0), pii.train_on(frame(spark, texts).limit(0))).count() == 0
