"""Cases in which an operator once did less than the whole job."""

import pytest

from collections import Counter

from pyspark.sql import functions as F

from docloom.llm import mixing, queries
from tests.llm.test_native_operators import SCHEMA, corpus


def test_registered_mixing_draws_the_mix(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame(corpus(5, 150), SCHEMA)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    want = Counter((r["doc_id"], r["_size"], r["_taken"]) for r in mixing.plan_mix(df, mixing.n_words(F.col("text"))).collect())
    split, tree = [], mixing.splitting_tree
    monkeypatch.setattr(mixing, "splitting_tree", lambda *a: split.append(a) or tree(*a))
    got = queries.op5_mixing(spark, str(tmp_path))
    assert Counter((r["doc_id"], r["size"], r["taken"]) for r in got.collect()) == want
    assert split
    mix = mixing.mix
    monkeypatch.setattr(mixing, "mix", lambda docs, **options: mix(docs, **options).where("_shard > 0"))
    assert sum(r["taken"] for r in queries.op5_mixing(spark, str(tmp_path)).collect()) < sum(k[2] * n for k, n in want.items())


def test_text_without_spaces_takes_linear_time():
    """4 MB in one run of letters, of Chinese and of base64: the ids are the library's, in about its time."""
    import base64
    import random
    import time

    from docloom.llm import bpe
    from docloom.llm.queries import tokenizer_path

    codec, rnd = bpe.Codec(tokenizer_path()), random.Random(3)
    say = {"letters": "".join(rnd.choices("abcdefghij", k=4_000_000)), "cjk": "".join(map(chr, rnd.choices(range(0x4E00, 0x5600), k=1_300_000))), "base64": base64.b64encode(rnd.randbytes(3_000_000)).decode()}
    for text in (*say.values(), say["cjk"][:50_000] + " x " + say["letters"][:50_000] + " 日 y " + say["base64"][:50_000]):
        began = time.perf_counter()
        got = codec.encode(text)
        mine = time.perf_counter() - began
        began = time.perf_counter()
        assert got.tolist() == codec.library.encode(text, add_special_tokens=False).ids
        assert mine < 3 * (time.perf_counter() - began) + 1


@pytest.mark.parametrize("change", [{"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "use_regex": True}}, {"decoder": None}])
def test_other_tokenizers_are_refused(tmp_path, change):
    import json
    from pathlib import Path

    from docloom.llm import bpe
    from docloom.llm.queries import tokenizer_path

    spec = json.loads(Path(tokenizer_path()).read_text(encoding="utf-8")) | change
    (tmp_path / "t.json").write_text(json.dumps(spec), encoding="utf-8")
    with pytest.raises(ValueError, match=next(iter(change))):
        bpe.Codec(str(tmp_path / "t.json"))
