"""The operators' contracts in plain Python, one text after the other."""

import calendar
import collections
import hashlib
import math
import re
import zlib

import xxhash

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
BENCH_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def simhash(text):
    w = SPACE_WORD.findall(lower(text or ""))
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(rows):
    """doc_id -> component_id for (doc_id, text)."""
    prints = [simhash(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[top(i)] = min(least.get(top(i), doc), doc)
    return [(doc, f"{prints[i]:016x}", least.get(top(i))) for i, (doc, _) in enumerate(rows)]


def quality(text):
    w = SPACE_WORD.findall(text or "")
    n, seen, dup = len(w), set(), 0
    for line in (text or "").split("\n"):
        if SPACE_WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = collections.Counter(tuple(w[i : i + 5]) for i in range(n - 4))
    hit = {j for i in range(n - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    failed = n < 10 or 100 * len(hit) > 20 * n
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(hit), failed


def removed_lines(rows, min_docs, max_share, max_docs):
    """(kept, text without frequent lines, words removed) by index for (doc_id, source, text): the line frequency rule alone."""
    norm = lambda x: re.sub(r"[\x20\x09-\x0D]+", " ", re.sub("[0-9]", "0", x.lower())).strip()
    hosts, having = collections.defaultdict(set), collections.defaultdict(set)
    for d, s, t in rows:
        hosts[s].add((d, t))
        for x in (t or "").split("\n"):
            if SPACE_WORD.search(x):
                having[s, norm(x)].add((d, t))
    frequent = {k for k, docs in having.items() if len(docs) > min_docs and (len(docs) > max_share * len(hosts[k[0]]) or len(docs) > max_docs)}
    out = []
    for _, s, t in rows:
        lines = (t or "").split("\n")
        gone = [x for x in lines if SPACE_WORD.search(x) and (s, norm(x)) in frequent]
        n, lost = len(SPACE_WORD.findall(t or "")), sum(len(SPACE_WORD.findall(x)) for x in gone)
        left = "\n".join(x for x in lines if not SPACE_WORD.search(x) or (s, norm(x)) not in frequent) if gone else t
        out.append((not (gone and (n - lost < 10 or n - lost < 0.3 * n)), left, lost))
    return out


def contamination(docs, items):
    grams = {}
    for item, text in items:
        w = BENCH_WORD.findall(lower(text or ""))
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            grams.setdefault(tuple(w[k : k + n]), set()).add(str(item))
    out = []
    for doc, text in docs:
        w, hit, found = BENCH_WORD.findall(lower(text or "")), set(), set()
        for n in {len(g) for g in grams}:
            for k in range(len(w) - n + 1):
                if g := grams.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= g
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


def secrets(text):
    text = text or ""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    n = [sum(k == x for _, k, _ in spans) for x in range(3)]
    joined = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(spans))
    return (*n, hashlib.sha256(joined.encode()).hexdigest())


def language_model(rows):
    held = [zlib.crc32(b"" if d is None else str(d).encode()) % 7 == 2 for d, _ in rows]
    texts = [[*SPACE_WORD.findall(lower(t or "")), None] for _, t in rows]
    c, pairs, context, after = collections.Counter(), collections.Counter(), collections.Counter(), collections.defaultdict(set)
    for w, h in zip(texts, held, strict=True):
        if not h:
            c.update(w)
            for a, b in zip([0, *w[:-1]], w, strict=True):
                pairs[a, b] += 1
                context[a] += 1
                after[a].add(b)
    n, v = sum(c.values()), len(c)
    plain = lambda w: (c[w] + 1) / (n + v + 1)
    out = []
    for (d, _), w, h in zip(rows, texts, held, strict=True):
        score = 0.0
        for a, b in zip([0, *w[:-1]], w, strict=True):
            p = plain(b) if not context[a] else max(pairs[a, b] - 0.75, 0) / context[a] + 0.75 * len(after[a]) / context[a] * plain(b)
            score += math.log10(p)
        out.append((d, h, len(w), sum(c[x] > 0 for x in w), n, sum(math.log10(plain(x)) for x in w), score))
    return out


def repeats(rows):
    """For (doc_id, text): n_bytes, n_removed, n_spans, hash of what is kept."""
    first = {}
    big = 1 << 62
    for d, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - 49):
            first[b[k : k + 50]] = min(first.get(b[k : k + 50], big), big if d is None else d)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < (big if d is None else d):
                gone[k : k + 50] = b"\1" * 50
        spans = len(bytes(gone).replace(b"\0", b" ").split())
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


def moved_date(text, key, back=False):
    """The pseudonym of a written date, in plain Python: two fields below their radices, ten rounds of keyed shifts."""
    days = [(m, d) for m in range(1, 13) for d in range(1, calendar.monthrange(1801, m)[1] + 1)]
    leap = [y for y in range(1800, 2200) if calendar.isleap(y)]
    real = lambda y, m, d: 1 <= m <= 12 and 1 <= d <= calendar.monthrange(y, m)[1] if y else False

    def permuted(values, radices, tweak):
        v = list(values)
        for r in range(9, -1, -1) if back else range(10):
            other = ",".join(str(x) for j, x in enumerate(v) if j % 2 != r % 2)
            for i in range(len(v)):
                if i % 2 == r % 2:
                    shift = int(hashlib.sha256("|".join((key, tweak, str(r), str(i), other)).encode()).hexdigest()[:12], 16)
                    v[i] = (v[i] - shift if back else v[i] + shift) % radices[i]
        return v

    if "-" in text:
        order, (y, m, d), widths = "ymd", map(int, text.split("-")), (2, 2)
        if not real(y, m, d):
            return text
        allowed = days
    else:
        a, b, c = text.split("/")
        y, widths = int(c), (len(a), len(b))
        if real(y, int(b), int(a)):
            order, m, d = "dmy", int(b), int(a)
            allowed = [(p, q) for p, q in days if (widths[0] == 2 or q < 10) and (widths[1] == 2 or p < 10)]
        elif real(y, int(a), int(b)):
            order, m, d = "mdy", int(a), int(b)
            allowed = [(p, q) for p, q in days if q > 12 and (widths[0] == 2 or p < 10)]
        else:
            return text
    if not 1800 <= y < 2200:
        return text
    tweak = f"date {order} {widths[0]} {widths[1]}"
    if (m, d) == (2, 29):
        y = leap[permuted([leap.index(y)], [97], f"{tweak} leap")[0]]
    else:
        i, j = permuted([y - 1800, allowed.index((m, d))], [400, len(allowed)], tweak)
        y, (m, d) = 1800 + i, allowed[j]
    x = {"ymd": (y, m, d), "dmy": (d, m, y), "mdy": (m, d, y)}[order]
    return f"{y}-{m:02}-{d:02}" if order == "ymd" else f"{x[0]:0{widths[0]}}/{x[1]:0{widths[1]}}/{y}"


def all_spans(text, rules):
    """Spans of every rule as (start, rank, end), by Python's own regular expressions."""
    out = []
    for rank, rule in enumerate(rules):
        for m in re.finditer(rule.pattern, text or "", re.ASCII):
            if len(m[rule.group]) >= rule.least:
                out.append((m.start(), rank, m.end()))
    return sorted(out)


def trie(rows):
    """Nodes of the rebuilt conversations, for (conv_id, turn, role, text)."""
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            same = hashlib.sha256(f"{len(role.encode())}:{role}:{text}".encode()).hexdigest()[:32]
            own[c].append(((turn is not None, turn or 0, same), role, text))
    turns = {c: [x[1:] for x in sorted(t)] for c, t in own.items()}
    rebuilt = {}
    for c, mine in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = tuple(turns.get(c - int(math.fmod(c, 5)), [])[:h] + mine[h:])
    members, children = collections.defaultdict(list), collections.defaultdict(set)
    for c, t in sorted(rebuilt.items()):
        for d in range(len(t) + 1):
            members[t[:d]].append(c)
            if d:
                children[t[: d - 1]].add(t[:d])
    out = []

    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[x] for x in children[node]) or 1
        saved[node] = sum(saved[x] for x in children[node]) + (len(members[node]) - 1) * (len(node[-1][1].encode()) if node else 0)
    for node, of in members.items():
        ends = ",".join(str(c) for c in of if rebuilt[c] == node)
        out.append((of[0], len(node), members[node[:-1]][0] if node else None, len(of), len(children[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def url_verdict(url, rules, listed, default="allow"):
    """host, path, rule, verdict of an address; rules: (host, path, verdict), listed: (host, path)."""
    _, found, rest = (url or "").partition("://")
    host = re.match("[^/?#]*", rest)[0] if found else ""
    path = re.match("[^?#]*", rest[len(host) :])[0] if found else ""
    host = lower(host)
    fits = lambda h, p: (host == h or host.endswith("." + h)) and path.startswith(p)
    best = max(((len(h + p), len(h), h + p, v) for h, p, v in rules if fits(h, p)), default=None)
    if best:
        return host, path, best[2], best[3]
    return host, path, None, "block" if any(fits(h, p) for h, p in listed) else default


def kmeans(rows, k=8, rounds=10, dims=64):
    """vec_id, cluster, distance of kept vectors, and the final centroids, in plain integers."""
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(1024 * x) for x in v]))
    of = lambda i: hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest()
    centres = [v for _, v in sorted(kept, key=lambda x: (of(x[0]), x[1]))[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centres))
    for _ in range(rounds):
        groups = collections.defaultdict(list)
        for _, v in kept:
            groups[near(v)[1]].append(v)
        for j, g in groups.items():
            centres[j] = [sum(x) // len(g) for x in zip(*g, strict=True)]
    return [(i, near(v)[1], near(v)[0]) for i, v in kept], centres


def _luhn_ok(digits):
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def _feistel(values, radices, key, tweak, back=False):
    """Ten rounds over places of either parity."""
    values = list(values)
    for r in reversed(range(10)) if back else range(10):
        other = ",".join(str(v) for j, v in enumerate(values) if j % 2 != r % 2)
        for i, v in enumerate(values):
            if i % 2 == r % 2:
                shift = int(hashlib.sha256(f"{key}|{tweak}|{r}|{i}|{other}".encode()).hexdigest()[:12], 16)
                values[i] = (v - shift if back else v + shift) % radices[i]
    return values


def _feistel_text(text, key, tweak, back=False):
    kind = lambda c: (10, 48) if "0" <= c <= "9" else (26, 97) if "a" <= c <= "z" else (26, 65) if "A" <= c <= "Z" else None
    free = [c for c in text if kind(c)]
    new = iter(_feistel([ord(c) - kind(c)[1] for c in free], [kind(c)[0] for c in free], key, tweak, back))
    return "".join(chr(next(new) + kind(c)[1]) if kind(c) else c for c in text)


def picked_cards(run):
    """(start, length) of the cards in a run of digits, spaces and hyphens."""
    from boxwright.llm import pii

    found = []
    for i in range(len(run)):
        if run[i].isdigit() and (i == 0 or not run[i - 1].isdigit()):
            for n in range(13, 38):
                t = run[i : i + n]
                digits = [int(c) for c in t if c.isdigit()]
                if len(t) == n and (i + n == len(run) or not run[i + n].isdigit()) and re.fullmatch(pii.CARD, t) and 13 <= len(digits) <= 19 and _luhn_ok(digits):
                    found.append((2 * (not re.fullmatch(pii.USUAL, t)) + (not re.match(pii.ISSUER, t)), i, -n))
    taken = []
    for _, i, less in sorted(found):
        if all(i - less <= x or x + n <= i for x, n in taken):
            taken.append((i, -less))
    return sorted(taken)


def moved_card(t, key, back=False):
    from boxwright.llm import pii

    issuer = (re.match(pii.ISSUER, t) or [""])[0]
    while True:
        body = issuer + _feistel_text(t[len(issuer) : -1], key, f"card {issuer}", back)
        t = next(body + str(d) for d in range(10) if _luhn_ok([int(c) for c in f"{body}{d}" if c.isdigit()]))
        if issuer or not re.match(pii.ISSUER, t):
            return t


def moved_run(run, key, back=False):
    picked, new = picked_cards(run), run
    while picked:
        for i, n in picked:
            new = new[:i] + moved_card(new[i : i + n], key, back) + new[i + n :]
        if picked_cards(new) == picked:
            break
    return new


def moved_value(m, key, back=False):
    """The pseudonym of one value that is no card and no date."""
    from boxwright.llm import pii

    if "@" in m:
        head, dot, top = m.rpartition(".")
        return _feistel_text(head, key, "email", back) + dot + top
    if re.fullmatch(pii.DATE, m):
        return moved_date(m, key, back)
    if re.fullmatch(pii.ADDRESS, m):
        octets = m.split(".")
        if any(int(o) > 255 or len(o) > 1 and o[0] == "0" for o in octets):
            return m
        return ".".join(map(str, _feistel([int(o) for o in octets], [256] * 4, key, "address", back)))
    if re.fullmatch(pii.SOCIAL, m):
        return _feistel_text(m, key, "social", back)
    if re.match("[A-Z]{2}", m):
        number = lambda t: int("".join(str(int(c, 36)) for c in t))
        plain = m.replace(" ", "")
        if number(plain[4:] + plain[:4]) % 97 != 1:
            return m
        tail = _feistel_text(m[4:], key, "iban", back)
        return m[:2] + f"{98 - number(tail.replace(' ', '') + m[:2] + '00') % 97:02}" + tail
    lead = re.match(r"\+[0-9]{1,3}(?=[ .-]|\()[ .-]?|\+[0-9]|1[ .-](?=[0-9]{3}[.-])|", m)[0]
    return lead + _feistel_text(m[len(lead) :], key, "phone", back)


def pseudonymised(text, key, back=False):
    """The text with every value replaced."""
    from boxwright.llm import pii

    if text is None:
        return None
    cards = lambda part: re.sub(pii.RUN, lambda m: moved_run(m[0], key, back), part)
    out, end = [], 0
    for m in re.finditer(pii.ANY, text):
        out += [cards(text[end : m.start()]), moved_value(m[0], key, back)]
        end = m.end()
    return "".join(out) + cards(text[end:])
