"""Texts and plain helpers of these tests."""

import random
import re

#: Columns whose names the operators use inside.
CLASHES = ["id", "row", "rank", "length", "node", "key", "comp", "seed", "pos", "ref", "_id", "_salt", "score_", "hash", "word", "piece"]



def tokens(text):
    """Words as the contracts name them."""
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0d]+", lower)


def prose(n, seed, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}x{r.randrange(50)}" for _ in range(n))


#: Nulls, empties, white space, one word, long runs, controls, planes beyond the first.
ODD = [(1, None), (2, ""), (3, " \t\n\x0b"), (4, "one"), (5, "a" * 5000), (6, "x\x00y\x85z 　 \U0001f600 İ ΣΣ"),
       (7, "It's 'start !!'s <|endoftext|> 12345"), (None, "no id here at all my friend"), (8, "same words in this text ok"),
       (8, "same words in this text ok"), (9, "word " * 9000)]
