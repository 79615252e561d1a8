import random

import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from creditloom.llm.tokens import Encoder


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_literal_special_tokens_have_the_ids_of_an_untouched_tokenizer(name):
    random.seed(1)
    plain = Tokenizer.from_file(public_tokenizers.path(name))
    texts = [
        "one <|endoftext|> two", "one <|ENDOFTEXT|> two", "One<|endoftext|>Two", "<|endoftext|>", "<|endoftext|><|startoftext|>", None, "no token", "",
        "<|<|endoftext|>|>", "<|endof\ntext|>", " <|startoftext|> \n<|endoftext|>\n ", "<|StartOfText|> a <|endoftext|>",
    ]
    bits = ["<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", " ", "\n", "\n\n", "A", "it's", "é", "ΑΣ", "<|", "|>", "endoftext"]
    texts += ["".join(random.choice(bits) for _ in range(random.randint(0, 9))) for _ in range(2000)]
    encoder = Encoder(public_tokenizers.path(name))
    for column in (pa.array(texts), pa.array(["x", *texts], pa.large_string()).slice(1)):
        ids, count = encoder.encode(column, 7)
        at = 0
        for text, n in zip(texts, count.tolist()):
            assert ids[at : at + n].tolist() == [*plain.encode(text or "", add_special_tokens=False).ids, 7], repr(text)
            at += n
        assert at == len(ids)
