"""The two ways to merge a pre-token, and the cache of encoded ones."""

import random

import public_tokenizers

from foldwise.llm import bpe


def test_bpe_scan_equals_the_queue_and_the_cache_keeps_what_is_asked_for():
    own = bpe.BpeCodec(public_tokenizers.path("byte_bpe_50k.json"))
    rnd = random.Random(7)
    for _ in range(2000):
        data = bytes(rnd.choices(rnd.choice([b"etaoin shrdlu", b"aab", bytes(range(256))]), k=rnd.randrange(90)))
        sym = [own.byte_id[b] for b in data]
        ids = own.merge(data)
        assert ids == own.merge_long(list(sym)) == own.merge_short(list(sym))
        assert own.decode_joined(",".join(map(str, ids))) == data.decode("utf-8", "replace")
    asked = []
    memo = bpe._Memo(lambda k: asked.append(k) or k * 2, 10)
    for i in range(200):
        assert memo["often"] == "oftenoften" and memo[f"x{i}"] == f"x{i}" * 2
    assert asked.count("often") == 1 and len(memo) + len(memo.older) <= 20
