import random
from collections import Counter

from corpusloom.llm import licenses
from corpusloom.llm.licenses import COVERAGE, TEMPLATES, Scanner, align


def test_notices_at_the_threshold_without_their_telling_words():
    scanner = Scanner(TEMPLATES)
    spread = Counter(w for t in scanner.templates.values() for w in set(t))
    for name, t in scanner.templates.items():
        missing = max(m for m in range(len(t)) if (len(t) - m) / len(t) >= COVERAGE)
        telling = sorted(range(len(t)), key=lambda i: (t[i] not in scanner.keys[name], spread[t[i]], -len(t[i]), t[i], i))
        gone = set(telling[:missing])
        text = [f"qzx{i}" if i in gone else w for i, w in enumerate(t)]
        assert scanner.keys[name] & set(text), name
        if len(align(text, t)) / len(t) >= COVERAGE:
            assert name in {f[0] for f in scanner.scan(" ".join(text))}, name


def test_mit_line_in_other_words():
    for start in ("Licensed", "Distributed"):
        found = Scanner(TEMPLATES).scan(f"notes of the project. {start} under the MIT License. And more")
        assert [(f[0], f[1]) for f in found] == [("MIT line", 0.8)]


def test_key_words_lose_nothing():
    """Scans that look only around key words find what scans around every word of a template find."""
    r = random.Random(8)
    templates = {k: licenses.TEMPLATES[k] for k in ("Apache-2.0 line", "MIT line", "GPL-3.0 line", "CC-BY-4.0", "MPL-2.0")}
    quick, slow = licenses.Scanner(templates), licenses.Scanner(templates)
    slow.keys = {name: set(t) for name, t in slow.templates.items()}
    slow.wanted = set().union(*slow.keys.values())
    filler = [f"w{i}" for i in range(50)]
    for _ in range(150):
        words = r.choices(filler, k=r.randint(0, 30))
        for name in r.sample(sorted(templates), r.randint(1, 2)):
            t = licenses.words(templates[name])[0]
            for i in r.sample(range(len(t)), r.randint(0, len(t) // 4)):
                t[i] = r.choice(filler)
            words += t + r.choices(filler, k=r.randint(0, 20))
        text = " ".join(words)
        assert [f[0] for f in quick.scan(text)] == [f[0] for f in slow.scan(text)], text


def test_coverage_counts_words():
    t = licenses.words(licenses.TEMPLATES["GPL-3.0 line"])[0]
    scanner = licenses.Scanner({"x": " ".join(t)})
    for missing in range(5):
        found = scanner.scan("before " + " ".join(t[: len(t) - missing]) + " after it all")
        share = (len(t) - missing) / len(t)
        assert ([round(f[1], 9) for f in found] == [round(share, 9)]) if share >= 0.8 else not found


def test_many_notices_in_one_text_take_linear_time():
    import time

    scanner, line = Scanner(TEMPLATES), "licensed under the MIT License. "
    took = []
    for n in (2_500, 10_000):
        start = time.process_time()
        found = scanner.scan((line + "then other words of the project follow for a while here and there. ") * n)
        took.append(time.process_time() - start)
        assert len(found) == n and all(a[3] <= b[2] for a, b in zip(found, found[1:]))
    assert took[1] < 8 * took[0] + 0.5
