"""Tokens and sentence ends of a text are found at once; a plain loop over tokens gives the same and takes longer."""

import random
import re
import time

from marlstone.functions import chunking as C

_TOKEN = re.compile(rf"[{C.SINGLE}]|[^\x20\x09-\x0D{C.SINGLE}]+")


def plain(text, size):
    spans, ends, begin = [m.span() for m in _TOKEN.finditer(text)], [], 0
    for n, (start, end) in enumerate(spans, 1):
        behind = spans[n][0] if n < len(spans) else len(text)
        word = text[start:end].rstrip(C.CLOSERS) or text[start:end]
        if word[-1] in "。！？；" or word[-1] in ".!?;" and behind > end or "\n" in text[end:behind] or n - begin == size or n == len(spans):
            ends.append(n)
            begin = n
    return spans, ends


def test_tokens_and_sentence_ends_equal_a_plain_loop():
    rng, letters = random.Random(3), list("ab.!?;。！？；\"')」』） \n\t\r\x0b天地々かꀀ　é \x85\U0001f600\U00020001\x00")
    for _ in range(3_000):
        text, size = "".join(rng.choice(letters) for _ in range(rng.randint(0, 50))), rng.randint(1, 9)
        spans, ends = plain(text, size)
        found = C.token_spans(text)
        assert [tuple(x) for x in found.tolist()] == spans
        assert C.sentence_ends(text, found, size) == C.sentence_ends(text, spans, size) == ends


def test_han_text_takes_a_fraction_of_a_plain_loop():
    text = "天地玄黃宇宙洪荒日月盈昃辰宿列張。" * 20_000

    def least(run):
        times = []
        for _ in range(3):
            began = time.process_time()
            run()
            times.append(time.process_time() - began)
        return min(times)

    assert least(lambda: C.sentence_ends(text, C.token_spans(text), C.SIZE)) < 0.5 * least(lambda: plain(text, C.SIZE))
