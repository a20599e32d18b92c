import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tagsight.llm.tokens import Encoder


class Counting:
    """A tokenizer that counts the characters it is given."""

    def __init__(self, inner):
        self.inner, self.seen = inner, 0

    def encode_batch_fast(self, texts, **options):
        self.seen += sum(map(len, texts))
        return self.inner.encode_batch_fast(texts, **options)


@pytest.mark.parametrize(("file", "spaced"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_the_library_sees_a_word_once_whatever_signs_follow_it(file, spaced):
    path = public_tokenizers.path(file)
    words = [f"{a}wört{b}{c}" for a in "abcdefgh" for b in "klmnoprs" for c in "tuvw"]
    signs = ["", ".", ",", "!", "?", ";", ":", "...", ")", "%%%", "-", '"']
    texts = ["\n".join(" ".join(w + s for w in words[i : i + 8]) for i in range(0, len(words), 8)) for s in signs]
    own = Encoder(path, spaced)
    own.tokenizer = Counting(own.tokenizer)
    got = own.encode(texts)
    assert own.tokenizer.seen < 3 * len("".join(words))  # 12 times before
    plain = Tokenizer.from_file(path)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
