import random

import pyarrow as pa
import public_tokenizers
import pytest

from creditloom.llm.tokens import Encoder


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_give_the_ids_of_whole_texts(name):
    random.seed(1)
    texts = [
        "", "  ", " a  b ", "a\n b", "a \nb", "x\ny", "\n", "a\n\nb", "a\tb", "a\rb", "it's  ok 's", "\x1c a\x1d b", "A B <|endoftext|> d <|endoftext|>",
        "ΑΣ Σ ΣΑΣ.", "a  b", "a  b 　 c", "« a »", "“x” y", "ﬁ é É é ́", "İ İ i̇", "\x85 \x85x y", "Long " * 50,
    ]
    texts += ["".join(random.choice(" \n\ta'sSé́.9<|Σ  ") for _ in range(random.randint(0, 14))) for _ in range(3000)]
    encoder = Encoder(public_tokenizers.path(name))
    for _ in range(2):  # the second time all pieces are known
        ids, count = encoder.encode(pa.array(texts), 7)
        at = 0
        for text, n in zip(texts, count.tolist()):
            want = encoder.tokenizer.encode(text, add_special_tokens=False).ids
            assert ids[at : at + n].tolist() == [*want, 7], repr(text)
            at += n
        assert at == len(ids)


def test_null_and_no_texts():
    encoder = Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    ids, count = encoder.encode(pa.array([None, "", None], pa.string()), 2)
    assert ids.tolist() == [2, 2, 2] and count.tolist() == [1, 1, 1]
    assert len(encoder.encode(pa.array([], pa.string()), 2)[0]) == 0
