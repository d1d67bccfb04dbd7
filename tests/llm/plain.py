"""The contracts of the training-data queries in plain Python, for small inputs."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def joined(spans):
    return ",".join(":".join(map(str, s)) for s in spans)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def quality(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed"""
    found = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    triples = [tuple(found[i : i + 3]) for i in range(len(found) - 2)]
    often = Counter(triples)
    inside = {i + k for i, x in enumerate(triples) if often[x] > 1 for k in range(3)}
    n = len(found)
    return (
        n,
        sum(map(len, found)),
        len(re.findall(r"[#*$%&|<>]", text or "")),
        len(lines) - len(set(lines)),
        len(inside),
        n < 50 or 100 * len(inside) > 50 * n,
    )


def copies(rows):
    """doc_id -> (keep_id, group_size, kept, sha)"""
    groups = defaultdict(list)
    for key, text in rows:
        groups[sha((text or "").translate(AZ))].append(key)
    return {
        (key, max(group), len(group), key == max(group), digest)
        for digest, group in groups.items()
        for key in group
    }


def shingle_set(text, width):
    found = [w for w in words((text or "").translate(AZ))]
    if not found:
        return frozenset()
    if len(found) < width:
        return frozenset([tuple(found)])
    return frozenset(tuple(found[i : i + width]) for i in range(len(found) - width + 1))


def components(rows, width, percent):
    """doc_id -> (n_shingles, smallest doc_id reachable)"""
    sets = {key: shingle_set(text, width) for key, text in rows}
    parent = {key: key for key in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            small, large = sorted((len(sets[a]), len(sets[b])))
            if small and 100 * small >= percent * large:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (small + large - both):
                    x, y = sorted((root(a), root(b)))
                    parent[y] = x
    return {(key, len(sets[key]), root(key)) for key in sets}


def secrets(text):
    """n_assign, n_access, n_hex, base spans"""
    text = text or ""
    pattern = (
        r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]"""
        r"""|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?"""
        r"""([A-Za-z0-9+/_.=-]+)"""
    )
    found = [(0, "assign", *m.span()) for m in re.finditer(pattern, text) if len(m[2]) >= 8]
    found += [(1, "access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(2, "hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    found.sort(key=lambda s: (s[2], s[0]))
    counts = Counter(s[1] for s in found)
    return counts["assign"], counts["access"], counts["hex"], [s[1:] for s in found]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def personal(text):
    """counts by kind, base spans"""
    text = text or ""
    found = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        found.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            found.append(("phone", *m.span()))
    counts = Counter(s[0] for s in found)
    return [counts[k] for k in ("email", "ip", "card", "phone")], found


def archive_rows(rows):
    """(page_id, html) -> expected records"""
    groups = defaultdict(list)
    for key, html in rows:
        groups[(html or "").encode()].append(key)
    out = set()
    for data, keys in groups.items():
        first = max(keys)
        for key in keys:
            other = len(data) >= 1000 and key != first
            out.add(
                (
                    key,
                    len(data),
                    hashlib.sha1(data).hexdigest(),
                    "revisit" if other else "response",
                    first if other else None,
                )
            )
    return out


def token_ids(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def ids_crc(ids):
    return zlib.crc32(b"".join(int(i).to_bytes(4, "little") for i in ids))
