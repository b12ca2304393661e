import random

import numpy as np
import public_tokenizers
import pytest

from scholarsieve.llm import encoding, packing, tokens

PATHS = {tokens: public_tokenizers.path("byte_bpe_50k.json"), packing: public_tokenizers.path("word_bpe_49k.json")}
both = pytest.mark.parametrize("module", [tokens, packing])


def ids(encoder, texts):
    return [np.frombuffer(bytes(memoryview(i)), "<u4").tolist() for i in encoder.encode(texts)]


@both
def test_blocks_are_divided_as_the_rule_divides_each_text(module):
    rng = random.Random(7)
    letters = "aAbstTrevmldS'' \"  \n\t\r.,!09é²ß¼«_"
    texts = ["".join(rng.choice(letters[:rng.choice([9, 16, 24, len(letters)])]) for _ in range(rng.randrange(25))) for _ in range(4000)]
    texts += ["", "don't we'll 's 'S x''s \n's", "they're'", "a' b'", "'", "'l", "a  b \n c  ", "longerthaneight longerthaneighty"]
    data, starts, bounds = module.Encoder(PATHS[module]).plain(texts)
    number, parts = encoding.distinct_parts(data, starts)
    assert len(set(parts)) == len(parts)
    want = [module._PARTS.findall(text.lower() if module is packing else text) for text in texts]
    assert [[parts[k] for k in number[a:b]] for a, b in zip(bounds[:-1], bounds[1:])] == want


@both
def test_a_block_looks_each_distinct_part_up_once(module):
    encoder, asked = module.Encoder(PATHS[module]), []

    class Counting(encoding.Remembered):
        def __getitem__(self, part):
            asked.append(part)
            return super().__getitem__(part)

    encoder.known = Counting(1000)
    texts = ["x cat x dog x cat" + " x dog" * 50] * 20
    assert ids(encoder, texts) == [one.ids for one in encoder.whole.encode_batch(texts, add_special_tokens=False)]
    assert len(asked) == len(set(asked)) <= 5


@both
def test_frequent_words_outlive_rare_ones_in_bounded_memory(module, monkeypatch):
    monkeypatch.setattr(module, "REMEMBERED", 40)
    encoder = module.Encoder(PATHS[module])
    learned, keep = [], encoder.learn

    def learn():
        learned.extend(encoder.known.unseen)
        keep()

    encoder.learn = learn
    for k in range(300):
        [got] = ids(encoder, [f"y the frequent w{chr(97 + k % 26)}{chr(97 + k // 26)}qz"])
        assert got == encoder.whole.encode(f"y the frequent w{chr(97 + k % 26)}{chr(97 + k // 26)}qz", add_special_tokens=False).ids
        assert len(encoder.known) + len(encoder.known.old) <= 40 + 8
    assert sum(part.strip() == "frequent" for part in learned) == 1
