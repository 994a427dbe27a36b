"""HTML extraction on varied pages with labelled blocks, and its second pass against a plain one.

A block's text starts with ``+`` if it belongs to the article and with ``-`` if not.
"""

import random
from collections import Counter

import pytest

from tenure.llm import html_extract

LONG = "The committee said in a report that the bridge is to be closed for repairs, and that it was in need of them."
ALSO = "It is not known when the work will begin, but the town has asked for a plan that is both cheap and quick."
TALK = "I think that this is the best thing that has been said on the matter, and I agree with all of it in full."
MENU = "<ul><li><a href=/>- Home</a><li><a href=/n>- News of the day</a><li><a href=/c>- Contact</a></ul>"
SHORT = "+ Nobody was hurt."


def by_class(names, inner):
    return "".join(f"<div class='{n}'>{inner}</div>" for n in names)


PAGES = {
    "compound names": f"""<body><div class="site-header"><p>- The Daily Bridge</p></div><div class="main-menu">{MENU}</div>
        <div class="content has-sidebar"><h1>+ Bridge closed</h1><p>+ {LONG}</p><p>{SHORT}</p><p>+ {ALSO}</p></div>
        <div class="page-sidebar"><p>- {TALK}</p></div><div class="site-footer"><p>- {LONG}</p><p>- All rights kept</p></div>""",
    "comments after an article": f"""<main><article><h1>+ Bridge closed</h1><p>+ {LONG}</p><p>+ {ALSO}</p></article>
        <section class="comment-list"><h2>- Two replies</h2><article class="comment-body"><p>- {TALK}</p></article>
        <article class="comment-body"><p>- {TALK}</p><p>- So true.</p></article></section>
        <div id="userComments"><p>- {TALK}</p></div></main>""",
    "related posts": f"""<div id=wrap><h1>+ Bridge closed</h1><p>+ {LONG}</p><p>+ {ALSO}</p>
        <div class="related-posts"><h3>- More</h3><p>- {TALK}</p></div><h3>- Others read</h3>
        <ul><li><a href=1>- A story on the mill and the river</a><li><a href=2>- A story on the old road</a></ul></div>""",
    "adverts in the text": f"""<div class=post><h1>+ Bridge closed</h1><div class="ad-container"><p>- {TALK}</p></div><p>+ {LONG}</p>
        <div class="ads-top">- Buy now</div><p>{SHORT}</p><div class="cookie-consent"><p>- {TALK}</p></div><p>+ {ALSO}</p></div>""",
    "link list in an article": f"""<article><h1>+ Bridge closed</h1><p>+ {LONG}</p>
        <ul><li><a href=1>- A story on the mill</a><li><a href=2>- A story on the road</a></ul>
        <p>{SHORT}</p><p>+ Nor was anyone surprised.</p><p><a href=r>+ The report in full</a></p></article><p>- Share</p>""",
    "short paragraphs": "<body><div><a href=/>- Home</a> <a href=/n>- News</a></div><p>+ The bridge is shut.</p><p>+ Nobody was hurt.</p><p>+ Work begins in May.</p><div><a href=x>- Next page of this</a></div>",
    "chinese": "<body><div><a href=/>- 首页</a></div><h1>+ 桥梁关闭</h1>" + "<p>+ " + "委员会在报告中表示该桥梁将关闭维修因为它确实需要这样做" * 2 + "</p>" + "<p>+ 没有人受伤。</p><p>+ " + "目前尚不清楚工程何时开始但该镇已要求制定一项计划" * 2 + "</p><div><a href=x>- 下一页</a></div>",
    "no article element": f"""<table><tr><td>{MENU}</td><td><h1>+ Bridge closed</h1>+ {LONG}<br><br>+ {ALSO}<br><br>{SHORT}</td></tr></table>
        <p><a href=1>- Imprint of the site</a> | <a href=2>- Privacy</a></p>""",
    "layout names": f"""<div class="content-sidebar-wrap"><div class="layout-sidebar-left"><h1>+ Bridge closed</h1><p>+ {LONG}</p><p>+ {ALSO}</p></div>
        <aside><p>- {TALK}</p></aside></div>""",
    "words of a state": f"""<article class="post-12 comments-open with-share"><h1>+ Bridge closed</h1><p>+ {LONG}</p>
        <div class="share-buttons"><a href=x>- Share</a> <span>- this</span></div><p>{SHORT}</p></article>""",
    "header in an article": f"<header><p>- {TALK}</p></header><article><header><h1>+ Bridge closed</h1><p>+ By a reporter</p></header><p>+ {LONG}</p><footer><p>- {TALK}</p></footer></article>",
    "form and notice": f"<p>+ {LONG}</p><form><p>- {TALK}</p></form><div class='newsletter-signup'><p>- {TALK}</p></div><p>+ {ALSO}</p><nav>{MENU}</nav>",
    "text with links": f"<div><p>+ {LONG} <a href=x>See the report</a> and {ALSO}</p><p>+ {ALSO}</p><p><a href=y>- Read another story</a></p></div>",
    "quoted and listed": f"<article><p>+ {LONG}</p><blockquote><p>+ We had no choice.</p></blockquote><ul><li>+ Cost: 4 million<li>+ Time: 2 years</ul><p>+ {ALSO}</p></article><div role=complementary><p>- {TALK}</p></div>",
}


def marked(page):
    """Whether each text marked in the page is kept, as (wanted, kept) pairs."""
    kept = html_extract.main_text(page)
    clean = [w for w in html_extract._TOKEN.sub("\n", page).split("\n") if w.strip()[:2] in ("+ ", "- ")]
    kept_texts = Counter(" ".join(line.split()) for line in kept.split("\n\n"))
    out = []
    for text in clean:
        text = " ".join(text.split())
        found = any(k.startswith(text) or text in k for k in kept_texts)
        out.append((text[0] == "+", found))
    return out


def test_blocks_of_varied_pages():
    pairs = [p for page in PAGES.values() for p in marked(page)]
    good = sum(w for w, _ in pairs)
    hits, kept = sum(w and k for w, k in pairs), sum(k for _, k in pairs)
    assert good > 40 and len(pairs) - good > 30
    assert hits / good >= 0.9 and hits / kept >= 0.9


@pytest.mark.parametrize("name", PAGES)
def test_no_page_is_lost(name):
    kept = html_extract.main_text(PAGES[name])
    assert kept and sum(w and k for w, k in marked(PAGES[name])) >= 0.75 * sum(w for w, _ in marked(PAGES[name]))


@pytest.mark.parametrize(
    "name",
    "site-footer site-header comment-list comment-body user-comments related-posts cookie-consent "
    "ad-container main-menu page-sidebar ads-top siteFooter CommentList sponsored_links".split(),
)
def test_compound_names_are_left_out(name):
    for around in ("<body>%s", "<main>%s</main>", "<article>%s</article>"):
        page = around % f"<p>{LONG}</p><div class='{name}'><p>{TALK}</p></div><p>{ALSO}</p>"
        assert html_extract.main_text(page) == f"{LONG}\n\n{ALSO}", around
    # Nothing else on the page: the name is not enough.
    assert html_extract.main_text(f"<div class='{name}'><p>{LONG}</p></div>") == LONG


def test_every_rule_decides_blocks():
    by = Counter(r for page in PAGES.values() for _, r in html_extract.decisions(html_extract.blocks_of(page)))
    assert set(by) == set(range(6)) and by[html_extract.LINKS] >= 10 and by[html_extract.NEIGHBOURS] >= 10


def test_columns_of_the_same_name_and_long_pages(spark):
    long = "<nav><a href=x>menu</a></nav>" + f"<p>{LONG}</p><p>short</p>" * 20_000 + f"<p>{LONG}</p>"
    rows = spark.createDataFrame([(1, long, "old", "u"), (2, None, "old", "u")], "page_id long, html string, main_text string, place string")
    found = {r["page_id"]: r for r in html_extract.extract(rows).collect()}
    assert found[1]["main_text"] == "\n\n".join([LONG, "short"] * 20_000 + [LONG]) and found[1]["place"] == "u"
    assert found[2]["main_text"] == "" and html_extract.extract(rows).columns == rows.columns


def slow_second_pass(blocks, decided, names):
    """For every undecided block a walk to both sides."""
    out = []
    taking = [not (b.place == html_extract.IN_OUTSIDE or (names and b.place == html_extract.IN_NAMED)) for b in blocks]
    for i, block in enumerate(blocks):
        if decided[i] is not None:
            out.append(decided[i][0])
            continue
        sides = []
        for step in (-1, 1):
            k, gap, label = i + step, 1, False
            while 0 <= k < len(blocks):
                if not taking[k]:
                    k += step
                    continue
                if blocks[k].main != block.main:
                    # The edge of its own element is good; from outside, the last block of the other counts.
                    met, label = blocks[k].main, True
                    while not block.main and 0 <= k < len(blocks) and (not taking[k] or blocks[k].main == met):
                        if taking[k] and decided[k] is not None:
                            label = decided[k][0]
                            break
                        k += step
                    break
                if decided[k] is not None:
                    label = decided[k][0]
                    break
                gap, k = gap + 1, k + step
            else:
                label = block.main > 0
            sides.append((gap, label))
        (left, a), (right, b) = sides
        if a == b or block.heading:
            out.append(b)
        elif block.main:
            out.append(True)
        elif left != right:
            out.append(a if left < right else b)
        else:
            out.append(html_extract.stop_share(block.text) >= html_extract.SOME_STOP_SHARE)
    return out


def test_second_pass_equals_a_walk_to_both_sides():
    rng = random.Random(4)
    for _ in range(400):
        blocks, main = [], 0
        for _ in range(rng.randint(0, 25)):
            if rng.random() < 0.2:
                main = 0 if main else len(blocks) + 1
            text = rng.choice([LONG, "short", "the of it", "word word word"])
            links = len(text) if rng.random() < 0.3 else 0
            blocks.append(html_extract.Block(text, links, rng.random() < 0.2, main, False, rng.choice([0, 0, 0, 1, 2])))
        for names in (True, False):
            decided = html_extract._decided(blocks, names)
            got = [g for g, _ in html_extract._second_pass(blocks, decided, names)]
            want = slow_second_pass(blocks, decided, names)
            assert got == want
