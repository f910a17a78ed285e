"""Plain Python forms of the operators, for small fixtures."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
BARE = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c)
        total += x if i % 2 == 0 else 2 * x - 9 if x > 4 else 2 * x
    return total % 10 == 0


def pii(text):
    """Base spans (start, kind index, end)."""
    out = []
    for k, (kind, pattern) in enumerate(PII.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind != "ip" or all(int(p) < 256 for p in m[0].split(".")), "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def listed(spans):
    names = list(PII)
    return ",".join(f"{names[k]}:{a}:{b}" for a, k, b in spans)


def quality(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    w = WORD.findall(text)
    runs = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(runs)
    hit = {i + j for i, r in enumerate(runs) if n[r] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def substrings(docs, k=50):
    """doc_id -> (n_words, n_removed, kept)."""
    words = {i: WORD.findall(t or "") for i, t in docs}
    first = {}
    for i, w in words.items():
        for j in range(len(w) - k + 1):
            run = tuple(w[j : j + k])
            first[run] = min(first.get(run, i), i)
    out = {}
    for i, w in words.items():
        gone = {j + d for j in range(len(w) - k + 1) if first[tuple(w[j : j + k])] < i for d in range(k)}
        out[i] = len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)
    return out


def contamination(docs, items, k=10):
    """doc_id -> (n_words, n_hit, sorted item ids)."""
    windows = defaultdict(set)
    for i, t in items:
        w = BARE.findall(lower(t or ""))
        n = min(k, len(w))
        for j in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[j : j + n])].add(str(i))
    out = {}
    for i, t in docs:
        w = BARE.findall(lower(t or ""))
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for j in range(len(w) - n + 1):
                if x := windows.get(tuple(w[j : j + n])):
                    hit |= set(range(j, j + n))
                    found |= x
        out[i] = len(w), len(hit), sorted(found)
    return out


def jaccard(docs, k=5):
    """doc_id -> (class id, links), over distinct shingle sets."""
    sets = {}
    for i, t in docs:
        w = WORD.findall(t or "")
        n = min(k, len(w))
        sets[i] = frozenset(tuple(w[j : j + n]) for j in range(len(w) - n + 1)) if w else frozenset()
    lead = {}
    for i in sorted(sets):
        lead.setdefault(sets[i], i)
    parent, links = {i: i for i in sets}, Counter()

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = [i for s, i in lead.items() if s]
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                links[a] += 1
                links[b] += 1
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (find(lead[s]) if s else i, links[lead[s]] if s else 0) for i, s in sets.items()}


def pairs(docs, k=5):
    """As ``jaccard``, for rows of which only 2n and 2n + 1 can be linked."""
    out = {}
    for at in range(0, len(docs), 2):
        out |= jaccard(docs[at : at + 2], k)
    return out


def context(text):
    """Words of the context: lower case, numbers as 0, cut at blanks and behind punctuation."""
    text = re.sub("[0-9]+", "0", lower(text))
    return [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub(r"([\"'`=,;:<>(){}\[\]|#!?*&$%])", r"\1 ", text)) if w]


def shape(value):
    if not re.search("[A-Za-z]", value):
        return re.sub("[0-9]", "0", value)
    if re.fullmatch("[a-z0-9]{16,}", value) or re.fullmatch("[A-Z0-9]{16,}", value):
        return "x16" if value == value.lower() else "X16"
    return re.sub("[0-9]+", "0", re.sub("[A-Z]+", "A", re.sub("[a-z]+", "a", value)))


def occurrences(text, found, kind, credentials=()):
    """(start, kind, end, value, patterns) of the matches of one expression, with the gaps around them."""
    found, letter, out = list(found), re.compile(r"[a-z\x80-\U0010FFFF]"), []
    for i, m in enumerate(found):
        value = m[0] if kind >= 0 or " " in m[0] or "(" in m[0] or ")" in m[0] else re.sub("[./+_~-]+$", "", m[0])
        words = context(text[found[i - 1].end() if i else 0 : m.start()])[-4:]
        after = (context(re.match(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]*", text[m.end() : found[i + 1].start() if i + 1 < len(found) else len(text)])[0]) or [""])[0]
        names = [(f"b{k}", " ".join(words[-k:])) for k in (1, 2, 3) if len(words) >= k] + [("a1", after)]
        names = [(sort, x) for sort, x in names if letter.search(x)]
        if op := re.search(r"([=:])(?: [\"'`])?$", " ".join(words)):
            names.append(("operator", op[1]))
        names.append(("shape", shape(value)))
        own = kind
        if kind < 0:
            key = re.search(r"([a-z_-]+) ?[=:](?: [\"'`])?$", " ".join(words))
            own = 4 if re.fullmatch("(?:AKIA|ASIA)[A-Z0-9]{16}", value) or (key and key[1] in credentials) else -1
        out.append((m.start(), own, m.start() + len(value), value.lower(), names))
    return out


def bootstrapped(texts, token, numbers, credentials, support=3, confident=0.5, agree=0.25, accept=0.6):
    """All spans of each text, as the operator lists them: base, seeds of secrets, and what patterns and instances accept."""
    names = [*PII, "secret"]
    base, free = [pii(t) for t in texts], []
    every, grams = Counter(), Counter()
    for row, t in enumerate(texts):
        t = t or ""
        for k, pattern in enumerate(PII.values()):
            good = {(a, e) for a, kind, e in base[row] if kind == k}
            for a, _, e, value, f in occurrences(t, re.finditer(pattern, t), k):
                if (a, e) in good:
                    every.update((x, k, value) for x in f)
        some = occurrences(t, re.finditer(token, t), -1, credentials)
        some += [x for x in occurrences(t, re.finditer(numbers, t), -1, credentials) if re.search("[ ()]", t[x[0] : x[2]])]
        for a, k, e, value, f in some:
            if len(value) < 4:
                continue
            if not any(b < e and a < c for b, _, c in base[row]):
                free.append((row, a, k, e, value, f))
                every.update((x, k, value) for x in f)
        w = context(t)
        for k in (1, 2, 3):
            grams.update(" ".join(w[i : i + k]) for i in range(len(w) - k + 1))
    known = Counter({x: n for x, n in every.items() if x[1] >= 0})
    unknown = {(f, v): n for (f, k, v), n in every.items() if k < 0}
    accepted = {}
    while True:
        values, times, others, more = defaultdict(set), Counter(), defaultdict(set), Counter()
        for (f, k, v), n in known.items():
            values[f, k].add(v)
            times[f, k] += n
        for (f, v), n in unknown.items():
            others[f].add(v)
            more[f] += n
        trust = {}
        for f in {f for f, _ in values}:
            kinds = [k for k in range(5) if (f, k) in values]
            best = max(kinds, key=lambda k: (len(values[f, k]), -k))
            if len(values[f, best]) < support:
                continue
            if f[0] in ("operator", "shape"):
                c = len(values[f, best]) / (sum(len(values[f, k]) for k in kinds) + len(others[f]))
            else:
                c = times[f, best] / max(grams[f[1]], sum(times[f, k] for k in kinds) + more[f])
            trust[f] = best, c
        views = defaultdict(lambda: defaultdict(float))
        for f, v in unknown:
            if f in trust and trust[f][1] >= agree:
                k, c = trust[f]
                sort = f[0] if f[0] in ("operator", "shape") else "lexical"
                views[v, k][sort] = max(views[v, k][sort], c)
        fresh = {}
        for (v, k), x in views.items():
            err = 1 - x["shape"]
            score = max(1 - (1 - x["lexical"]) * err if x["lexical"] >= confident else 0, 1 - (1 - x["operator"]) * err if min(x["operator"], x["shape"]) >= agree else 0)
            if score >= accept and (v not in fresh or (score, -k) > fresh[v]):
                fresh[v] = score, -k
        if not fresh:
            break
        accepted |= {v: -k for v, (_, k) in fresh.items()}
        for (f, v), n in list(unknown.items()):
            if v in fresh:
                known[f, accepted[v], v] += n
                del unknown[f, v]
    out = [list(x) for x in base]
    for row, a, k, e, value, f in free:
        placed = len(value) >= 8 or any(x in trust and x[0] not in ("operator", "shape") and trust[x][1] >= confident for x in f)
        if k >= 0 or (value in accepted and placed):
            out[row].append((a, k if k >= 0 else accepted[value], e))
    return [",".join(f"{names[k]}:{a}:{e}" for a, k, e in sorted(x)) for x in out]


def hidden_markov(texts, lm, known, own):
    """Log10 likelihood of each text: tied passes, the last maximisation word by word, plain recursions."""
    import numpy as np

    tokens = [[*(t or "").encode().lower().split(), None] for t in texts]
    train = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 7 != 2]
    c = Counter(w for i in train for w in tokens[i])
    total = sum(c.values()) + len(c) + 1
    steps = defaultdict(list)
    for w in c:
        if w is not None:
            steps[math.floor(64 * math.log2(c[w]))].append(w)
    ranked = []
    for step in sorted(steps, reverse=True):
        if len(ranked) + len(steps[step]) > known:
            break
        ranked += steps[step]
    ranked.sort(key=lambda w: (-c[w], w))
    alone = {w: ("word", w) for w in ranked[:own]} | {None: ("end",)}
    row = lambda w: alone.get(w) or (("class", lm.class_of(w)) if w in c else ("unseen",))
    share = Counter({("unseen",): 1 / total})
    for w in c:
        share[row(w)] += (c[w] + 1) / total
    mark = lambda r: {"end": 0, "unseen": 1}.get(r[0]) if len(r) == 1 else zlib.crc32(r[1]) if r[0] == "word" else (1 << 32) + r[1]
    emits = {r: x * lm._tilt(np.array([mark(r)], np.uint64))[0] / 2**20 for r, x in share.items()}
    norm = sum(emits.values())
    emits = {r: e / norm for r, e in emits.items()}
    s = lm.STATES
    moves = np.where(np.eye(s, dtype=bool), 0.9, 0.1 / (s - 1))
    start = np.full(s, 1 / s)

    def recursions(of, text):
        a, scale = [start * of(text[0])], []
        for t in range(len(text)):
            if t:
                a.append((a[-1] @ moves) * of(text[t]))
            scale.append(a[-1].sum())
            a[-1] = a[-1] / scale[-1]
        b = [np.ones(s)]
        for t in range(len(text) - 1, 0, -1):
            b.insert(0, moves @ (of(text[t]) * b[0]) / scale[t])
        return np.array(a), np.array(b), np.array(scale)

    for k in range(lm.PASSES):
        first, move, counts = np.zeros(s), np.zeros((s, s)), defaultdict(lambda: np.zeros(s))
        for i in train:
            of = lambda w: emits[row(w)]
            a, b, scale = recursions(of, tokens[i])
            g = a * b
            first += g[0]
            for t, w in enumerate(tokens[i]):
                counts[row(w) if k < lm.PASSES - 1 else w] += g[t]
                if t:
                    move += np.outer(a[t - 1], of(w) * b[t]) * moves / scale[t]
        states = sum(counts.values(), np.zeros(s))
        lean = lm.LEAN[0] + lm.LEAN[1] * states
        own_share = share if k < lm.PASSES - 1 else {w: (c[w] + 1) / total for w in c} | {("unseen",): 1 / total}
        emits = {r: (counts[r] + x * lean) / (states + lean) for r, x in own_share.items()}
        start, moves = (first + 1) / (first + 1).sum(), (move + 1) / (move + 1).sum(axis=1, keepdims=True)
    once = sum((counts[w] for w in c if c[w] == 1), np.zeros(s)) / (states + lean)
    emits = {r: e * (1 - once) + (once if r == ("unseen",) else 0) for r, e in emits.items()}
    assert np.allclose(sum(emits.values()), 1)
    return [math.log10(math.e) * np.log(recursions(lambda w: emits.get(w, emits["unseen",]), t)[2]).sum() for t in tokens]


def warc_records(data):
    """(header fields, block) of each record, by header end and length alone."""
    out = []
    while data:
        head, _, rest = data.partition(b"\r\n\r\n")
        fields = [tuple(x.split(": ", 1)) for x in head.decode().split("\r\n")[1:]]
        size = int(dict(fields)["Content-Length"])
        out.append((fields, rest[:size]))
        data = rest[size + 4 :]
    return out


def page(rng, depth=0):
    """A random tree: its markup, and its text as items (lines, apart from neighbours by a blank line)."""
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 6)))
    text = lambda: " ".join(word() for _ in range(rng.randint(1, 6)))
    markup, items = [], []
    for _ in range(rng.randint(1, 4)):
        kind = rng.choice(["p", "h2", "div", "ul", "ol", "table", "pre", "hidden", "ghost", "section"])
        t = text()
        if kind in ("p", "h2"):
            markup.append(f"<{kind}> {t.replace(' ', chr(10) + ' ', 1)} </{kind}>" if rng.random() < 0.5 else f"<{kind}><b>{t}</b></{kind}>")
            items.append(([t], True))
        elif kind == "div":
            markup.append(f"<div>{t}</div>")
            items.append(([t], False))
        elif kind in ("ul", "ol"):
            start, lines, parts = rng.randint(-3, 30), [], []
            first = f" start='{start}'" if kind == "ol" else ""
            for n in range(rng.randint(1, 4)):
                if n == 1 and kind == "ol" and rng.random() < 0.5:
                    start += 5
                    parts.append(f"<li value={start + n}>")
                else:
                    parts.append("<li>")
                mark = f"{start + n}. " if kind == "ol" else "- "
                inner, own = page(rng, depth + 1) if depth < 2 and rng.random() < 0.4 else (text(), None)
                own = laid_out(own).split("\n") if own is not None else [inner]
                parts.append(inner + rng.choice(["", "</li>"]))
                own = [x for x in own if x]
                lines += [(mark if i == 0 else " " * len(mark)) + x for i, x in enumerate(own)]
            markup.append(f"<{kind}{first}>{''.join(parts)}</{kind}>")
            items.append((lines, True))
        elif kind == "table":
            # Cells on a grid; some take two columns or two rows.
            wide, high = rng.randint(1, 4), rng.randint(1, 4)
            taken, rows, cells = set(), [], {}
            for y in range(high):
                row = ""
                for x in range(wide):
                    if (x, y) in taken:
                        continue
                    w = 2 if x + 1 < wide and (x + 1, y) not in taken and rng.random() < 0.2 else 1
                    h = 2 if y + 1 < high and rng.random() < 0.2 else 1
                    taken |= {(x + i, y + j) for i in range(w) for j in range(h)}
                    cells[x, y] = w, text()
                    row += f"<td{' colspan=2' if w == 2 else ''}{' rowspan=2' if h == 2 else ''}>{cells[x, y][1]}"
                rows.append(f"<tr>{row}</tr>")
            used = sorted({x for x, _ in cells})
            last = lambda x, w: max(c for c in used if c < x + w)
            width = dict.fromkeys(used, 0)
            for (x, _), (w, t) in sorted(cells.items(), key=lambda c: len([u for u in used if c[0][0] <= u < c[0][0] + c[1][0]])):
                within = [c for c in used if x <= c < x + w]
                width[last(x, w)] = max(width[last(x, w)], len(t) - sum(width[c] + 2 for c in within[:-1]))
            lines = []
            for y in range(high):
                line = ""
                for x in used:
                    if (x, y) in cells:
                        line = line.ljust(sum(width[c] + 2 for c in used if c < x)) + cells[x, y][1]
                if line:
                    lines.append(line.rstrip())
            markup.append(f"<table><tbody>{''.join(rows)}</tbody></table>")
            items.append((lines, True))
        elif kind == "pre":
            markup.append(f"<pre>{t}   x\n  {t}<div>{t}</div>{t}</pre>")
            items.append(([f"{t}   x", f"  {t}", t, t], True))
        elif kind == "hidden":
            markup.append(rng.choice(["<div style='color:red; display : none'>{}<p>{}</p></div>", "<p hidden>{}{}</p>", "<script>'{}{}</p>'</script>", "<!-- {} {} -->"]).format(t, t))
        elif kind == "ghost":
            markup.append(f"<div style='visibility:hidden'>{t}<div style='visibility: visible'>{t}</div>{t}</div>")
            items.append(([t], False))
        elif depth < 3:
            inner, own = page(rng, depth + 1)
            markup.append(f"<section>{inner}</section>")
            items += own
    return "".join(markup), items


def laid_out(items):
    out, before = [], False
    for lines, apart in items:
        if lines:
            if out and (apart or before):
                out.append("")
            out += lines
            before = apart
    return "\n".join(out)


def base_failed(text):
    n, _, _, _, repeats = quality(text)
    return n < 50 or 100 * repeats > 50 * n


def kept(text, rules):
    """The base rules, then an ordered list of (feature, above, cut) conjunctions."""
    text = text or ""
    n, chars, symbols, dup, repeats = quality(text)
    lines = sum(bool(WORD.search(x)) for x in text.split("\n"))
    share = lambda a, b: math.floor(a / max(b, 1) * 1000 + 0.5) / 1000
    row = (share(chars, n), share(symbols, n), share(dup, lines), share(repeats, n), share(len(re.findall("[A-Z]", text)), chars), share(text.count("!"), n), float(n))
    return not base_failed(text) and not any(all((row[c.feature] > c.cut) is c.above for c in r) for r in rules)


def redacted(text, spans):
    """Each span replaced by its kind; of overlapping ones the first."""
    out, at = "", 0
    for kind, a, b in ((k, int(a), int(b)) for k, a, b in (s.split(":") for s in spans.split(",") if s)):
        if a >= at:
            out += text[at:a] + f"<{kind}>"
        at = max(at, b)
    return out + text[at:]
