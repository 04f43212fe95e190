"""The piece encoder against the tokenizers library on whole texts."""

import numpy as np
import pytest

from simgrove.llm.tokens import PieceEncoder, vocabulary

TEXTS = [
    "", " ", "  a, b ,c", "don't, stop", "A. B.. c!?", "<|endoftext|> a, <|x|>", "é, É. ß; Œuvre, ŒUVRE! ǅ, İ. İstanbul, İ,", "日本語, abc。", "x\n\n y,\n", "é, á.",
    "3.14, 3,000", "Σς, ΑΣ.", "a\x0bb, c\x0b,", " a\xa0b, c", "ABC DEF, ghi THE the The", "___a_, -b-", "\U0001F600, hi!", "word word, word. Word, WORD.", "ÿ, Ÿ, µ, ª, º", "x" * 3000 + ",", "a" + "," * 500,
]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_are_those_of_whole_texts_also_after_forgetting(name):
    own = PieceEncoder(vocabulary(name))
    assert own.direct
    own.LIMIT, own.KEEP = 20, 10
    for texts in (TEXTS, TEXTS[::-1], [t for t in TEXTS for _ in range(2)]):
        want = [e.ids + [2] for e in own.tokenizer.encode_batch(texts, add_special_tokens=False)]
        ids, sizes = own.encode(texts, 2)
        assert sizes.tolist() == [len(w) for w in want]
        assert ids.tolist() == np.concatenate(want).tolist()
