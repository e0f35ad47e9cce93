"""What a tokenizing worker holds, and that its shorter ways give the tokenizer's ids."""

import numpy as np

from shelfgauge.llm import common, token_ids


def test_texts_reach_the_tokenizer_in_small_batches(make, monkeypatch):
    docs, seen = make([(1, "one two", None)]), []
    spark, written = docs.sparkSession, token_ids.written

    def noted(*args):
        seen.append(spark.conf.get(common.BATCH_SETTING, None))
        return written(*args)

    monkeypatch.setattr(token_ids, "written", noted)
    assert token_ids.write_ids(docs).count() == 1
    assert seen == [str(common.BATCH_BYTES)] and spark.conf.get(common.BATCH_SETTING, None) is None


def test_remembered_pieces_are_bounded_and_forgotten_ones_right(monkeypatch):
    monkeypatch.setattr(token_ids, "REMEMBERED", 50)
    encoder = token_ids.Encoder(token_ids.default_tokenizer())
    assert encoder.one_word
    batches = [[f"some wörd{'abcdefghij'[n]}{'abcdefghij'[k]} x{k * n}, end Çelik, ɐ don't" for k in range(10)] for n in range(10)]
    for batch in batches + batches[::-1]:
        coded = encoder.tokenizer.encode_batch_fast(batch, add_special_tokens=False)
        assert encoder.encode(batch) == [np.array(c.ids, "<u4").tobytes() for c in coded]
        assert len(encoder.known) + len(encoder.older) <= 4 * 50
