"""CRF extraction: parsing, training and decoding against brute force, held-out layouts, the pages table."""

import html
import itertools
import re

import numpy as np
import pytest

from tidewright.llm import html as H

FIELD = H.default_field()


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("   ", ""), ("<html><body><nav><a href=x>Home</a></nav></body></html>", ""),
        ("<article><p>One <b>bo</b>ld &amp; &lt;tag&gt;&nbsp;x\n\ty.<p>Two<br>lines.</article>", "One bold & <tag> x y. Two lines."),
        ("<nav><li>a<li>b</nav><article><h1>T</h1><script>var t='</p>';</script><p>Body.<!-- <p>no</p> --></p></article><footer>&copy; me</footer>", "T Body."),
        ("<body><header><p>Site</p></header><main><article><p>Text here.</p><aside>Related</aside><form><label>Mail</label></form>"
         '<div class="ad">Buy!</div><p>More.</p></article></main><section class="comments"><p>First!</p></section></body>', "Text here. More."),
        ("<article><p>" + "word " * 20_000 + "end.</p>", "word " * 20_000 + "end."),
        ("<article><p>a < b & c &unknown; &#233;&#x41;</p></article", "a < b & c &unknown; éA"),
        ("<article><style>p{}</style><p title='x > y'>ok.</p><noscript>on</noscript><p>un<!-- c -->split</p></article>", "ok. unsplit"),
    ],
)
def test_pages(page, text):
    assert H.main_text(page, FIELD) == text


def test_viterbi_is_the_best_labelling():
    rng = np.random.default_rng(1)
    for _ in range(30):
        names = [[f"f{rng.integers(5)}" for _ in range(3)] for _ in range(rng.integers(1, 7))]
        pair = lambda: tuple(rng.normal(size=2).tolist())
        f = H.Field({f"f{i}": pair() for i in range(4)}, (pair(), pair()), pair())

        def score(labels):
            s = f.first[labels[0]] + sum(f.weights.get(n, (0, 0))[y] for b, y in zip(names, labels, strict=True) for n in b)
            return s + sum(f.step[a][b] for a, b in itertools.pairwise(labels))

        assert score(f.decode(names)) == pytest.approx(max(map(score, itertools.product((0, 1), repeat=len(names)))))
    assert f.decode([]) == []


def test_held_out_layouts():
    pages = H.labelled_pages(120, seed=77)
    pairs = [(a, b) for p, y in pages for a, b in zip(FIELD.decode([H.features(b) for b in H.leaf_blocks(p)]), y, strict=True)]
    assert sum(a == b for a, b in pairs) > 0.985 * len(pairs)


def test_table(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    for r in H.extract(pages).collect():
        inner = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        known = " ".join(html.unescape(re.sub(r"<[^>]*>", lambda m: " " if re.match(r"</?(p|br|h1)\b", m[0]) else "", inner)).split())
        assert r.text == known and r.n_chars == len(known)


def test_frame(spark):
    rows = [(1, None, "x"), (1, "<article><p>One.</p></article>", "y"), (1, "<article><p>One.</p></article>", "y")]
    df = spark.createDataFrame(rows, "page_id long, html string, TEXT string")
    assert [(r.text, r.n_chars) for r in H.extract(df).collect()] == [("", 0), ("One.", 4), ("One.", 4)]
    assert H.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<article><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> hold.</p></article>", "Let x=2 hold."),
        ("<article><p>See <object data=a>the plan</object> and <svg><text>a mark</text><path d=M0/></svg>.</p></article>", "See the plan and a mark."),
        ("<article><p>One <template>two</template> three.</p></article>", "One two three."),
        *((f"<article><p>Before <{x}>it.</p><p>After it.</p></article>", "Before it. After it.") for x in ("math", "svg", "object", "template", "noscript")),
    ],
)
def test_only_raw_text_is_dropped(page, text):
    assert H.main_text(page, FIELD) == text
