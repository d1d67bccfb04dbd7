"""Plain Python statements of what the jobs must compute, for small inputs."""

from __future__ import annotations

from collections import Counter

import regex

# The GPT-2 pre-token pattern.
GPT2 = regex.compile(
    r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)


def replace_pair(symbols, pair):
    """From left to right; a symbol just made takes no part in another merge."""
    out, i = [], 0
    while i < len(symbols):
        width = 2 if tuple(symbols[i : i + 2]) == pair else 1
        out.append(pair[0] + pair[1] if width == 2 else symbols[i])
        i += width
    return tuple(out)


def pair_counter(words):
    found = Counter()
    for symbols, cnt in words.items():
        for pair in zip(symbols, symbols[1:]):
            found[pair] += cnt
    return found


def triple_counter(words):
    found = Counter()
    for symbols, cnt in words.items():
        for triple in zip(symbols, symbols[1:], symbols[2:]):
            found[triple] += cnt
    return found


def merge_words(words, pair):
    merged = Counter()
    for symbols, cnt in words.items():
        merged[replace_pair(symbols, pair)] += cnt
    return merged


def sequential_merges(words, limit):
    merges = []
    while len(merges) < limit:
        counted = pair_counter(words)
        if not counted:
            break
        best = max(counted, key=lambda pair: (counted[pair], pair))
        merges.append(best)
        words = merge_words(words, best)
    return merges


def byte_words(counter):
    return Counter({tuple(bytes([b]) for b in word.encode()): n for word, n in counter.items()})


def split_specials(text, specials):
    """Text cut around special tokens, the longest first, without empty parts."""
    parts, plain, i = [], "", 0
    ordered = sorted(specials, key=len, reverse=True)
    while i < len(text):
        hit = next((s for s in ordered if text.startswith(s, i)), None)
        if hit is None:
            plain += text[i]
            i += 1
            continue
        parts += [(False, plain), (True, hit)]
        plain = ""
        i += len(hit)
    parts.append((False, plain))
    return [part for part in parts if part[1]]


def encode(text, ids, ranks, specials=()):
    out = []
    for special, part in split_specials(text, specials):
        if special:
            out.append(ids.get(part.encode()))
            continue
        for word in GPT2.findall(part):
            symbols = tuple(bytes([b]) for b in word.encode())
            while True:
                ranked = [p for p in zip(symbols, symbols[1:]) if p in ranks]
                if not ranked:
                    break
                symbols = replace_pair(symbols, min(ranked, key=ranks.get))
            out += [ids.get(symbol) for symbol in symbols]
    return out
