import re

import numpy as np
import pyarrow as pa

from codeloom.llm import token_ids, words as w


def test_words_are_those_of_the_pattern():
    texts = ["a b\tcé\n", "", None, "é", "x", " ", "日 本", "no-space", "end"]
    for keep, pattern in ((w.NON_SPACE, r"[^\x20\x09-\x0D]+"), (w.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        for limit in (1, 6, 1 << 20):
            found = []
            for _, _, data, bounds in w.chunks(pa.array(texts), limit):
                starts, ends, first = w.cut(data, bounds, keep)
                raw = [data[a:b].tobytes().decode() for a, b in zip(starts, ends)]
                found += [raw[a:b] for a, b in zip(first[:-1], first[1:])]
            assert found == [re.findall(pattern, t or "") for t in texts]


def test_hashes_depend_on_the_word_alone():
    _, _, data, bounds = next(iter(w.chunks(pa.array(["ab cd ab", "AB cd"]))))
    starts, ends, _ = w.cut(data, bounds, w.NON_SPACE)
    plain, lower = w.hashes(data, starts, ends), w.hashes(data, starts, ends, lower=True)
    assert plain[0] == plain[2] != plain[3] and plain[1] == plain[4]
    assert lower[0] == lower[2] == lower[3]


def test_ids_come_back_from_coded_words():
    random = np.random.default_rng(5)
    for n in (0, 1, 59, 60, 61, 1023, 1024, 1025, 5000):
        for high in (1, 2, 300, 1 << 15, 50_257, 1 << 31):
            ids = random.integers(0, high, n).astype(np.uint32)
            coded = token_ids.pack(ids)
            assert (token_ids.unpack(n, *coded) == ids).all()
    ones = token_ids.pack(np.zeros(1020, np.uint32))[0]
    assert len(ones) == 17  # 60 zeros to a word
