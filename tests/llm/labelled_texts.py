"""Sentences with labelled personal data, written apart from the tagger's own training generator: other words, names, hosts and number plans."""

import random

FIRST = "james olivia noah emma liam sofia lucas mia hannah omar priya kenji amelie sven chloe diego".split()
LAST = "walker novak okafor tanaka muller rossi petit silva haugen kowalski mehta osei dubois lindqvist".split()
HOSTS = "brightfield lakeside harborlight silverline quickpost greenhill redwood meridian northgate bluepeak".split()
TOPS = "com org net info eu fr".split()
LEADS = ["Please contact {} before Friday", "Her new details are {} as of today", "Reach the desk under {} in the morning", "The record shows {} next to the name", "We wrote down {} during the call", "Kontakt: {} (Zentrale)", "Merci de joindre {} pour la suite", "Send everything to {}, thanks", "last seen: {}; no reply yet", "{} was on the form"]
PLAIN = ["The meeting at the old mill starts at 10:30 and ends by noon", "Version 2.10.3 was released on 2021-04-17 to 1,250 users", "He paid 14.50 for a dot matrix printer in 1987", "Chapter 12, section 4.2 covers pages 118-131", "The score was 3-2 after 90 minutes at the stadium", "Order #48213 has 7 items of 250 g each", "See table (4) at the end of part [12]", "In 2019/2020 the index rose 3.7 points to 10,482", "Trains leave at 06:15, 07:45 and 09:05 dot on time"]


def luhn_number(rng, n):
    d = [rng.randrange(10) for _ in range(n - 1)]
    total = sum(x * 2 - 9 * (x > 4) if k % 2 == 0 else x for k, x in enumerate(reversed(d)))
    return "".join(map(str, d)) + str(-total % 10)


def grouped(text, sizes, sep):
    out = []
    for n in sizes:
        out.append(text[:n])
        text = text[n:]
    return sep.join(out)


def entity(rng, kind):
    """A value that the base patterns miss."""
    if kind == "email":
        user = rng.choice([f"{rng.choice(FIRST)}.{rng.choice(LAST)}", f"{rng.choice(FIRST)}{rng.randrange(99)}", f"{rng.choice(FIRST)[0]}{rng.choice(LAST)}", rng.choice(LAST)])
        at, dot = rng.choice([("(at)", "."), ("[at]", "[dot]"), ("[at]", "."), (" (at) ", " (dot) "), (" at ", " dot "), ("{at}", "."), (" [at] ", ".")])
        return f"{user}{at}{rng.choice(HOSTS)}{dot}{rng.choice(TOPS)}"
    if kind == "ip":
        return rng.choice(["[.]", "(.)"]).join(str(rng.randrange(1, 255)) for _ in range(4))
    if kind == "card":
        n, sizes = rng.choice([(16, (4, 4, 4, 4)), (15, (4, 6, 5))])
        return grouped(luhn_number(rng, n), sizes, rng.choice([".", "/", "  ", "_"]))
    return rng.choice([f"({rng.randrange(200, 999)}) {rng.randrange(200, 999)}-{rng.randrange(1000, 9999)}", f"{rng.randrange(200, 999)}-{rng.randrange(200, 999)}-{rng.randrange(1000, 9999)}", f"{rng.randrange(200, 999)}.{rng.randrange(200, 999)}.{rng.randrange(1000, 9999)}", f"0{rng.randrange(20, 89)} {rng.randrange(1000, 9999)} {rng.randrange(1000, 9999)}", f"00{rng.randrange(20, 89)} {rng.randrange(20, 99)} {rng.randrange(100, 999)} {rng.randrange(1000, 9999)}"])


def labelled_texts(n, seed, kinds=("email", "ip", "card", "phone")):
    """(text, spans): sentences, each with no or one value that the base patterns miss, and plain ones around it."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        text, spans = rng.choice(PLAIN) + ". ", []
        for _ in range(rng.randrange(1, 4)):
            if rng.random() < 0.6:
                kind = rng.choice(kinds)
                lead, value = rng.choice(LEADS), entity(rng, kind)
                a = len(text) + lead.index("{}")
                text += lead.format(value) + rng.choice([". ", "\n", ". "])
                spans.append((kind, a, a + len(value)))
            else:
                text += rng.choice(PLAIN) + rng.choice([". ", "\n"])
        out.append((text, spans))
    return out


def found_by_kind(texts, spans_of):
    """{kind: (precision, recall)} of exact spans."""
    hit, said, true = {}, {}, {}
    for text, spans in texts:
        got = set(spans_of(text))
        for k, *_ in got:
            said[k] = said.get(k, 0) + 1
        for s in spans:
            true[s[0]] = true.get(s[0], 0) + 1
            hit[s[0]] = hit.get(s[0], 0) + (s in got)
    return {k: (hit[k] / max(1, said.get(k, 0)), hit[k] / true[k]) for k in true}
