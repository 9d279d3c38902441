"""A plain, row-at-a-time counterpart of the surrogates, for tests: own loops over the same fixed values."""

from hashlib import sha256

import regex

from tessera.llm import pii as P

FULL = {k: regex.compile(p) for k, p in P.PATTERNS.items()}
ANY, BARE, KEYWORD = regex.compile(P.ANY), regex.compile(P.BARE), regex.compile("^" + P.KEYWORD)
LEAD = regex.compile(f"^(?:(?:{P.TITLE} )+|{P.INTRODUCTION} )")


def digits(s):
    return "".join(c for c in s if c in "0123456789")


def luhn_sum(s):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(s)))


def right_iban(s):
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def block(address):
    return next((bits for p, bits in P.BLOCKS.items() if regex.match(p, address)), None)


def moved(address, key):
    """The next address in the keyed order of the block."""
    bits, number = block(address), 0
    for x in address.split("."):
        number = number * 256 + int(x)
    half, top, low = bits // 2, number >> bits, number & ((1 << bits) - 1)
    mask = (1 << half) - 1
    mix = lambda v, r: int(sha256("\x01".join([key, "block", str(top), str(r), str(v)]).encode()).hexdigest()[:8], 16) & mask
    a, b = low >> half, low & mask
    for r in (3, 2, 1, 0):
        a, b = b ^ mix(a, r), a
    place = ((a << half) + b + 1) % (1 << bits)
    a, b = place >> half, place & mask
    for r in range(4):
        a, b = b, a ^ mix(b, r)
    number = (top << bits) + (a << half) + b
    return ".".join(str(number >> k & 255) for k in (24, 16, 8, 0))


def kind_of(raw):
    for k, p in FULL.items():
        if p.fullmatch(raw) and (k != "card" or luhn_sum(digits(raw)) % 10 == 0) and (k != "iban" or right_iban(raw.replace(" ", ""))):
            return k
    return None


def parts_of(kind, raw):
    if kind == "email":
        return [("mailbox", raw.lower()), ("domain", raw.lower().split("@", 1)[1])]
    if kind == "name":
        lead = LEAD.match(raw)[0]
        said = lead.replace(".", "").split(" ")
        gender = next((g for g in ("f", "m") if set(said) & set(P.TITLES[g])), "n")
        words = raw[len(lead) :].split(" ")
        return [(f"given-{gender}", w.lower()) for w in words[:-1]] + [("surname", words[-1].lower())]
    if kind in ("card", "ssn"):
        return [(kind, digits(raw))]
    if kind == "phone":
        return [(kind, "+" * raw.startswith("+") + digits(raw))]
    if kind == "ipv4":
        return [("ipv4-block" if block(raw) else kind, raw)]
    if kind == "iban":
        return [(kind, raw.replace(" ", ""))]
    if kind == "secret":
        return [(kind, KEYWORD.sub("", raw))]
    return [(kind, raw)]


def surrogate(kind, norm, attempt, key):
    seed = "\x01".join([key, kind, norm, str(attempt)])
    noise = "".join(sha256(f"{seed}\x01{k}".encode()).hexdigest() for k in range(4))
    number = lambda i: int(noise[3 * (i % 85) :][:3], 16)

    def like(s, fixed=0, letters="abcdefghijklmnopqrstuvwxyz"):
        out = ""
        for i, c in enumerate(s):
            pool = "0123456789" if c in "0123456789" else letters if "a" <= c <= "z" else "ABCDEFGHIJKLMNOPQRSTUVWXYZ" if "A" <= c <= "Z" else None
            out += c if i < fixed or pool is None else pool[number(i) % len(pool)]
        return out

    more = noise[-20:][: min(attempt - 1, 20)] if attempt > 2 else ""
    if kind == "mailbox":
        return like(norm.split("@")[0]) + more
    if kind == "domain":
        new = like(norm)
        new = new[: new.rindex(".") + 1] + "example"
        return more + "." + new if more else new
    if kind == "ipv4-block":
        return moved(norm, key)
    if kind == "phone":
        code = regex.match(P.CALLING, norm)
        return like(norm, len(code[0]) if code else 0)
    if kind == "card":
        body = like(norm[:-1], 1)
        return body + str((10 - luhn_sum(body + "0") % 10) % 10)
    if kind == "ipv4":
        sixteen, public = [number(2 * k) + 16 * number(2 * k + 1) for k in range(4)], [n for n in range(1, 224) if n not in P.SPECIAL]
        return ".".join(map(str, [public[sixteen[0] % len(public)], *[1 + x % 254 for x in sixteen[1:]]]))
    if kind == "iban":
        account = like(norm[4:])
        whole = int("".join(str(int(c, 36)) for c in account + norm[:2] + "00"))
        return f"{norm[:2]}{98 - whole % 97:02d}{account}"
    if kind == "access":
        return like(norm, 4)
    if kind == "secret":
        return like(norm, letters="abcdef" if regex.fullmatch("[0-9a-f]+", norm) else "abcdefghijklmnopqrstuvwxyz") + more
    if kind == "ssn":
        return like(norm)
    script = "cyrillic" if regex.search(r"\p{IsCyrillic}", norm) else "greek" if regex.search(r"\p{IsGreek}", norm) else "latin"
    body = "".join(P.SYLLABLES[script][number(k) % 16] for k in range(3 + max(0, attempt - 2)))
    return body + (P.ENDINGS[script][kind[-1]] if kind.startswith("given") else "")


def distinct(parts, key):
    chosen, real, attempt = {}, set(parts), 0
    while parts:
        used = {(k, s) for (k, _), s in chosen.items()}
        made = {p: surrogate(*p, attempt, key) for p in parts}
        owner = {}
        for (k, n), s in sorted(made.items()):
            owner.setdefault((k, s), n)
        good = {p: s for p, s in made.items() if owner[p[0], s] == p[1] and ((p[0], s) not in real or p[0] == "ipv4-block") and (p[0], s) not in used}
        chosen |= good
        parts = parts - set(good)
        attempt += 1
    return chosen, attempt


def laid_out(kind, raw, s):
    if kind == "email":
        return f"{s[0]}@{s[1]}"
    if kind == "name":
        return LEAD.match(raw)[0] + " ".join(x.capitalize() for x in s)
    if kind in ("phone", "card", "ssn", "iban"):
        new = iter(s[0].lstrip("+"))
        return "".join(next(new) if c.isdigit() or (kind == "iban" and c.isalnum()) else c for c in raw)
    if kind == "secret":
        return KEYWORD.match(raw)[0] + s[0]
    return s[0]


def bare(gap, names):
    """The gap with its bare names replaced, and how many runs of them there are."""

    def of(w):
        new = names.get(w.lower())
        return new and (new.upper() if len(w) > 1 and w == w.upper() else new.capitalize())

    found, at = [], 0
    for m in BARE.finditer(gap):
        w = m[0]
        found.append((gap[at : m.start()], w, of(w) or "".join(of(p) or p for p in regex.split("(?<=['’-])|(?=['’-])", w, flags=regex.V1))))
        at = m.end()
    out, runs, before = "", 0, False
    for i, (g, w, new) in enumerate(found):
        ahead = found[i - 1][1] + " " if g == " " and i else g
        thing = regex.search(P.ARTICLE, ahead) and i + 1 < len(found) and found[i + 1][0] == " " and found[i + 1][1] == found[i + 1][2]
        if thing or w.lower() in P.MONTHS and regex.search(P.TIME, ahead):
            new = w
        out += g + new
        runs += new != w and not (before and g == " ")
        before = new != w
    return out + gap[at:], runs


def replace(rows, key):
    """rows (id, text) -> (id, text, n_entities, kinds)."""
    found = [[m for m in ANY.finditer(t or "")] for _, t in rows]
    kinds = {m[0]: kind_of(m[0]) for ms in found for m in ms}
    parts = {raw: parts_of(k, raw) for raw, k in kinds.items() if k}
    chosen, _ = distinct({p for ps in parts.values() for p in ps}, key)
    full, mail = {}, {}
    for raw, k in kinds.items():
        if k == "name" and len(parts[raw]) > 1:
            pair = (parts[raw][-2][1], parts[raw][-1][1])
            full.setdefault(pair, set()).update(parts[raw])
            new = (chosen[parts[raw][-2]], chosen[parts[raw][-1]])
            mail[pair] = min(new, mail.get(pair, new))
    out = []
    for (i, t), ms in zip(rows, found, strict=True):
        told = set()
        for run in regex.finditer(P.RUN, t or ""):
            ws = run[0].lower().split(" ")
            for pair in zip(ws, ws[1:], strict=False):
                told |= full.get(pair, set())
        named = sorted((n, k != "surname", k, chosen[k, n]) for k, n in {p for m in ms if kinds[m[0]] == "name" for p in parts[m[0]]} | told)
        names = {}
        for n, _, _, s in named:
            names.setdefault(n, s)
        said = {kinds[m[0]] for m in ms} - {None} | ({"name"} if told else set())
        if t is None or not said:
            out.append((i, t, 0, ""))
            continue
        new, at, n = "", 0, 0
        for m in [*ms, None]:
            gap, runs = bare(t[at : m.start() if m else len(t)], names) if names else (t[at : m.start() if m else len(t)], 0)
            new, n = new + gap, n + runs
            if m:
                k = kinds[m[0]]
                spelled = [chosen[p] for p in parts[m[0]]] if k else []
                box = regex.match(r"([a-z]+)([._-])([a-z]+)([0-9]*)@", m[0].lower()) if k == "email" else None
                if box and (box[1], box[3]) in mail:
                    given, surname = mail[box[1], box[3]]
                    spelled[0] = given + box[2] + surname + box[4]
                new += laid_out(k, m[0], spelled) if k else m[0]
                n, at = n + bool(k), m.end()
        out.append((i, new, n, ",".join(sorted(said))))
    return out
