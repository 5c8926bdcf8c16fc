"""Operators that SQL can't express against plain versions written from their description."""

import hashlib
import math
import random
import re

import numpy as np
import pytest

from calltally.llm import pii, toxicity, url_filter

RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def plain_address(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def plain_rule(host, path, rules):
    best = None
    for rule, verdict in rules:
        name, _, rest = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + rest):
            if best is None or len(rule) > len(best[0]):
                best = rule, verdict
    return best


def plain_form(segment):
    ending = re.search(r"\.[A-Za-z][A-Za-z0-9]{0,4}$", segment)
    ending = ending.group() if ending else ""
    stem = segment[: len(segment) - len(ending)]
    if re.fullmatch(r"[0-9]+", stem):
        stem = "{n}"
    elif re.fullmatch(r"[0-9]{1,4}-[0-9]{1,2}(-[0-9]{1,4})?", stem):
        stem = "{date}"
    elif re.fullmatch(r"[0-9a-fA-F-]{8,}", stem) and re.search("[0-9]", stem):
        stem = "{hex}"
    elif re.search("[0-9]{3,}", stem):
        stem = re.sub("[0-9]{3,}", "{n}", stem)
    elif len(stem) > 60:
        stem = "{long}"
    return stem + ending


def plain_verdicts(urls, rules):
    rows = []
    for url in urls:
        host, path = plain_address(url)
        parts = [x for x in path.split("/") if x]
        form = [plain_form(x) for x in parts[: url_filter.DEPTH]] + (["{rest}"] if len(parts) > url_filter.DEPTH else [])
        rows.append({"host": host, "path": path, "rule": plain_rule(host, path, rules), "form": form, "template": ""})
    for level in range(url_filter.DEPTH):
        nodes = {}
        for r in rows:
            child = r["form"][level] if level < len(r["form"]) else None
            branch = nodes.setdefault((r["host"], r["template"]), {}).setdefault(child, [0, 0, 0])
            branch[0] += 1
            if r["rule"]:
                branch[1 if r["rule"][1] == "block" else 2] += 1
        for r in rows:
            if level >= len(r["form"]):
                continue
            branches = nodes[r["host"], r["template"]]
            n, blocked, allowed = (sum(b[k] for b in branches.values()) for k in range(3))
            children = sum(c is not None for c in branches)
            cn, cb, ca = branches[r["form"][level]]
            alike = False
            if cb + ca:
                share = blocked / (blocked + allowed)
                alike = abs(cb / (cb + ca) - share) <= url_filter.Z * math.sqrt(share * (1 - share) / (cb + ca)) + 1e-9
            if children >= url_filter.MANY and cn < url_filter.FREQUENT * n:
                r["next"] = "/*"
            else:
                r["next"] = "/~" if alike else "/" + r["form"][level]
        for r in rows:
            r["template"] += r.pop("next", "")
    found = {}
    for r in rows:
        pure = found.setdefault((r["host"], r["template"]), [0, 0])
        if r["rule"]:
            pure[r["rule"][1] == "allow"] += 1
    out = []
    for r in rows:
        b, a = found[r["host"], r["template"]]
        score = (b + url_filter.PRIOR_BLOCKED) / (b + a + url_filter.PRIOR_BLOCKED + url_filter.PRIOR_ALLOWED)
        verdict = r["rule"][1] if r["rule"] else "block" if score >= 0.5 else "allow"
        out.append((r["host"], r["path"], r["rule"] and r["rule"][0], r["template"], round(score, 9), verdict))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_url_verdicts(spark, seed):
    rng = random.Random(seed)
    hosts = ["a.example.net", "example.com", "B.Example.COM", "x.org", "h.org"]
    words = ["en", "de", "fr", "ads", "blog", "p-%d", "%d", "%d.html", "2024-01-%02d", "item%d", "deadbeef%02d", "a/b/c/d/e/f"]
    rules = [*RULES, ("h.org/ads/1", "block"), ("h.org/blog/", "allow"), ("example.com/ads/", "block")]
    urls = [None, "", "nothing", "http://", "http://x.org?q#f"]
    for _ in range(600):
        path = "/".join(w % rng.randrange(40) if "%" in w else w for w in rng.choices(words, k=rng.randrange(1, 4)))
        urls.append(f"http://{rng.choice(hosts)}/{path}" + rng.choice(["", "/", "?a=1", "#x"]))
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: r for r in url_filter.judge(pages, rules).collect()}
    names = ("host", "path", "rule", "template", "score", "verdict")
    for k, want in enumerate(plain_verdicts(urls, rules)):
        row = tuple(round(got[k][n], 9) if n == "score" else got[k][n] for n in names)
        assert row == want, urls[k]


def plain_logit(text, table, bias, wordless):
    """The worst block's mean over the n-grams of its distinct words, found one by one."""
    shift = 32 - (len(table).bit_length() - 1)
    raw = (text or "").lower().encode()
    words = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in raw).split()
    best = -math.inf
    for at in range(0, len(words), toxicity.BLOCK):
        total, count = 0.0, 0
        for word in dict.fromkeys(words[at : at + toxicity.BLOCK]):
            padded = b" " + word + b" "
            for n in (3, 4, 5):
                for k in range(len(padded) - n + 1):
                    value = padded[k]
                    for c in padded[k + 1 : k + n]:
                        value = (value * 0x01000193 & 0xFFFFFFFF) ^ c
                    spread = (value + n) * 0x9E3779B1 & 0xFFFFFFFF
                    spread = (spread ^ spread >> 15) * 0x85EBCA77 & 0xFFFFFFFF
                    total += table[spread >> shift]
                    count += 1
        if count:
            best = max(best, total / (count + toxicity.STEADY) + bias)
    return wordless if best == -math.inf else best


def test_toxicity_logits():
    rng = random.Random(3)
    table = np.random.default_rng(4).normal(0, 5, 1 << 10)
    texts = ["", " ", None, "a", "ab cd", "a b c d", "É-été! x", "one two one two " * 30, "x" * 5000]
    texts += [" ".join("".join(rng.choice("abcdé ") for _ in range(rng.randrange(1, 9))) for _ in range(n)) for n in (5, 24, 25, 90)]
    got = toxicity.logits([t or "" for t in texts], table, -0.5, -1.25)
    want = [plain_logit(t, table, -0.5, -1.25) for t in texts]
    assert np.allclose(got, want)


def plain_feistel(left, right, a, b, key, tweak):
    for n in range(pii.ROUNDS):
        digest = hashlib.sha256(f"{key}|{tweak}|{n}|{right if n % 2 == 0 else left}".encode()).hexdigest()
        step = int(digest[:15], 16)
        if n % 2 == 0:
            left = (left + step) % a
        else:
            right = (right + step) % b
    return left, right


def plain_luhn(number):
    digits = [int(c) for c in reversed(number)]
    return (sum(digits[::2]) + sum(sum(divmod(2 * d, 10)) for d in digits[1::2])) % 10


def test_pseudonyms_value_by_value(spark):
    rng = random.Random(5)
    texts, want = [], []
    for _ in range(30):
        size = rng.choice([13, 16, 19])
        body = str(rng.randrange(1, 10)) + "".join(rng.choice("0123456789") for _ in range(size - 2))
        card = next(body + str(d) for d in range(10) if plain_luhn(body + str(d)) == 0)
        half = (size - 2) // 2
        left, right = plain_feistel(int(card[1 : 1 + half]), int(card[1 + half : -1]), 10**half, 10 ** (size - 2 - half), "k", f"card{card[0]}{size}")
        new = f"{card[0]}{left:0{half}}{right:0{size - 2 - half}}"
        texts.append(card)
        want.append(next(new + str(d) for d in range(10) if plain_luhn(new + str(d)) == 0))
        octets = [rng.randrange(256) for _ in range(4)]
        left, right = plain_feistel(octets[0] * 256 + octets[1], octets[2] * 256 + octets[3], 65536, 65536, "k", "ip")
        texts.append(".".join(map(str, octets)))
        want.append(f"{left // 256}.{left % 256}.{right // 256}.{right % 256}")
        area, exchange, line = rng.randrange(200, 1000), rng.randrange(200, 1000), rng.randrange(10000)
        left, right = plain_feistel((area - 200) * 800 + exchange - 200, line, 640_000, 10_000, "k", "phone")
        texts.append(f"+1 ({area}) {exchange}-{line:04}")
        want.append(f"+1 ({left // 800 + 200}) {left % 800 + 200}-{right:04}")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = [r["text"] for r in pii.pseudonymise(docs, "k").orderBy("doc_id").collect()]
    assert got == want
