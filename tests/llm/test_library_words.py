"""Words of texts through the tokenizers library, many at once, against the library on whole texts."""

import numpy as np
import pandas as pd
import public_tokenizers
from tokenizers import Tokenizer

from tidemark.llm import collocations, packed_ids

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "", "  \n ", "Hello, World's don't 123 x<|endoftext|>y <|startoftext|>Ab", "éa café café ΣΑΣ Σ.", "a\x1cb c",
    "日本語 テスト", "x y\xa0z　q\x85w", "a_b-c!!'s 'S 'll \U0001f600", "İstanbul ﬁ \xdf", "a\x00b ﻿ Hello,",
]


def test_words_learnt_together_equal_whole_texts():
    library = Tokenizer.from_file(PATH)
    library.no_truncation()
    library.no_padding()
    want = [library.encode(t, add_special_tokens=False).ids for t in TEXTS]
    encode = packed_ids.library_tokenizer(PATH, remembered=3)()  # the memory starts anew between calls
    for _ in range(2):
        for size in (1, 4, len(TEXTS)):
            got = [ids for at in range(0, len(TEXTS), size) for ids in encode(pd.Series(TEXTS[at : at + size]))]
            assert [g.tolist() for g in got] == want


def test_numbers_of_several_languages_in_one():
    by_lang = {}
    for lang, text in (("de", "Der Hund. der\tHund,"), ("en", "a dog\x0b a")):
        known = collocations.numbers()
        tokens = collocations.words(text)
        by_lang[lang] = known, [np.fromiter(map(known.__getitem__, tokens), np.int32, len(tokens))]
    ids, names, hashes = collocations.joined(by_lang, 42)
    assert [names[i][1].decode() for i in ids] == ["der", "hund", "", "der", "hund", "", "", "a", "dog", "", "a", ""]
    assert [names[i][0] for i in ids if i] == ["de"] * 4 + ["en"] * 3 and len(set(hashes)) == len(names) == 5
