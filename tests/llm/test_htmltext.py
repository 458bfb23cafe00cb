import html
import re
import time

from pixelloom.llm import htmltext as H


def page(title, paras, nav=("a", "b"), foot="x"):
    links = "".join(f'<li><a href="/{n}">{n}</a></li>' for n in nav)
    return (
        f'<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style><script>var t="</p>";</script></head><body><nav><ul>{links}</ul></nav><!-- ad --><div class="ad">Buy {foot}</div>'
        f"<article><h1>{title}</h1>{paras}</article><footer>&copy; {foot}</footer></body></html>"
    )


def test_plain_pages(spark):
    rows = []
    for i in range(30):
        rows.append((i, f"http://{'hot' if i % 3 else f'h{i}'}.org/p{i}", page(f"T {i} &amp; &am", f"<p>One\n {i} <b>bold{i} thing{i}.<br><p>Two{i}&nbsp;&lt;x&gt;\t y</p><p> </p>", nav=[f"n{k}" for k in range(i % 4)], foot=f"f{i}")))
    rows += [(100, None, None), (101, "", ""), (102, "http://hot.org/x", "just text"), (103, "http://hot.org/y", "<p>a<p>b"), (103, "http://hot.org/y", "<p>a<p>b"), (None, "http://hot.org/z", rows[1][2])]
    df = spark.createDataFrame([(p, u, h, "s") for p, u, h in rows], "page_id long, url string, html string, host string").repartition(3)
    got = {r.page_id: r for r in H.extract(df).collect()}
    for i in range(30):
        assert got[i].text == f"T {i} & &am\nOne {i} bold{i} thing{i}.\nTwo{i} <x> y" and got[i].n_chars == len(got[i].text)
    assert (got[100].text, got[100].url, got[101].text, got[102].text, got[103].text) == ("", None, "", "just text", "a\nb")
    assert got[None].text == got[1].text
    assert H.extract(df).count() == len(rows) and H.extract(df.limit(0)).count() == 0


def brute_rows(pages):
    """The occurrence table of a host's elements, counted page by page from the nodes."""
    paths, sums = H.Paths(), {}
    for i, page in enumerate(pages):
        nodes = H.nodes(page, paths)
        here = [0, *(n for n, _, t, _ in nodes if not t)]
        for n in set(here):
            below = [(len("".join(t.split())), link) for k, _, t, link in nodes if t and n in ancestry(paths, k)]
            r = sums.setdefault(n, [0, 0, (), 0, 0])
            r[:] = [r[0] + 1, r[1] + here.count(n), (*r[2], (i, here.count(n))), r[3] + sum(c for c, _ in below), r[4] + sum(c for c, k in below if k)]
    keys = ("pages", "times", "vector", "chars", "links")
    return [{"token": paths.code[n], "at": paths.code[paths.parent[n]], "tag": paths.tag[n], **dict(zip(keys, v, strict=True))} for n, v in sums.items()], paths


def ancestry(paths, n):
    out = [n]
    while n:
        n = paths.parent[n]
        out.append(n)
    return out


def test_slot_without_marks_and_nested_boilerplate():
    body = "<div class=top>Site</div><div><a href=/>Home</a><a href=/x>Other</a></div><div id='c{i}'><header><h2>{t}</h2></header><p>{p}</p><div>Share</div><section><p>first!</p></section><form>mail <input></form></div><div>aside text</div>"
    pages = [body.format(t=f"t{i}", p=f"words {i} " * 40, i=i) for i in range(5)]
    rows, paths = brute_rows(pages)
    slot, out, words = H.template(rows)
    assert slot == paths.code[paths.number[0, "div", 3]] and words == []
    assert H.main_text(pages[2], (slot, frozenset(out), frozenset())) == "t2\n" + ("words 2 " * 40).strip()
    assert "Share" in H.main_text(pages[2])


def test_names_do_not_decide():
    kept = "<div class='main-header-content'><p class='notice-period'>One month.</p></div>"
    assert H.main_text(kept) == "One month."
    assert H.main_text("<article><header><h2>Title</h2></header><p>x</p></article><footer>f</footer>") == "Title\nx"


def wanted(page):
    inner = re.search(r"<article>(.*?)(?:</article>|$)", page, re.S)[1]
    blocks = [re.sub(r"<[^>]*>", " " if "<br" in b else "", b.replace("<br>", " ")) for b in re.split(r"</?(?:p|h1)>", inner)]
    blocks = [re.sub(r"\s+", " ", html.unescape(b)).strip() for b in blocks]
    return re.sub(" +", " ", "\n".join(b for b in blocks if b))


def test_whole_table_against_the_generator(spark):
    """As given; and without article, and with another class and id on every element, where only the template can tell."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    truth = {r.page_id: wanted(r.html) for r in pages.collect()}
    turn = iter(range(10**9))
    bare = [(r.page_id, r.url, re.sub(r"<(div|nav|p|h1|footer|ul)[^>]*>", lambda m: f"<{m[1]} class='c{next(turn)}' id=i{next(turn)}>", re.sub("</?article>", "", r.html))) for r in pages.collect()]
    bare = spark.createDataFrame(bare, "page_id long, url string, html string").repartition(3)
    for df in (pages, bare):
        for r in H.extract(df).collect():
            assert re.sub(" +", " ", r.text) == truth[r.page_id], r.page_id
    alone = sum(re.sub(" +", " ", H.main_text(r.html)) == truth[r.page_id] for r in bare.collect())
    assert alone == 0  # without the template no page's article is found


def test_broken_long_and_deep_pages_take_linear_time():
    for piece in ("<p title='x ", "<p title='x >", "<div>", "<header>", "<li><ul><div>", "<button>", '<p a="', "<script>", "<!--", "<", "<td><table>", "</div>"):
        began = time.perf_counter()
        H.main_text(piece * (500_000 // len(piece)))
        assert time.perf_counter() - began < 5, piece
    assert H.main_text("<p>a<p title='open>b</p><p>c</p>") == "a\nb\nc"
    assert H.main_text("""<p title="x > y" data='a"b'>a <b>b</b></p><p don't>c</p><p class=x""") == "a b\nc"
    assert H.main_text("<p>1 < 2 <SCRIPT>var x='<p>';</SCRIPT ><p>b<svg>") == "1 < 2\nb"
    long = "<article>" + "<p>é word</p>" * 50_000 + "</article>"
    assert H.main_text(long) == "\n".join(["é word"] * 50_000)


def test_copies_of_a_page_keep_their_text(spark):
    one = page("T", "".join(f"<p>same words number {k} again</p>" for k in range(6)))
    df = spark.createDataFrame([(i, "http://copy.org/a", one) for i in range(8)], "page_id long, url string, html string")
    want = "\n".join(["T", *(f"same words number {k} again" for k in range(6))])
    assert {r.text for r in H.extract(df).collect()} == {want}


def test_ties_take_the_deepest_slot():
    rows, paths = brute_rows([f"<main><div><section><p>{'w ' * (9 + i)}</p></section></div></main>" for i in range(4)])
    assert H.template(rows)[0] == paths.code[3] and paths.tag[3] == "section"


def test_template_text_is_found_without_marks_or_names(spark):
    rows = []
    for i in range(12):
        order = ["<p>alpha beta gamma</p>", "<p>delta epsilon zeta</p>"][:: 1 if i % 2 else -1]  # same vector, two orders: no class
        body = f"<p>Unique{i} story{i} text{i} with{i} words{i}.</p>" + "".join(f"<p>part{i}x{k} more{i}y{k}</p>" for k in range(i % 4 + 1))
        rows.append((i, "http://plain.org/a", f"<body><div id=x><p>Welcome to our great site</p></div><div id=y>{body}<p>Copyright Plain Inc 2020</p></div></body>"))
        rows.append((100 + i, "http://mixed.org/a", f"<body><div id=y>{body}{''.join(order)}</div></body>"))
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r.text for r in H.extract(df).collect()}
    for i in range(12):
        parts = [f"Unique{i} story{i} text{i} with{i} words{i}."] + [f"part{i}x{k} more{i}y{k}" for k in range(i % 4 + 1)]
        assert got[i] == "\n".join(parts)
        assert {"alpha beta gamma", "delta epsilon zeta"} <= set(got[100 + i].split("\n")) and set(parts) <= set(got[100 + i].split("\n"))


def test_orders_of_classes():
    import numpy as np

    orders = lambda t, n: {c: v for (c, j), v in H.class_orders(np.array(t), np.array(n)).items() if j < 0}
    nested = orders([1, 7, 8, 7, 8, 2, 3], [0, 1, 1, 1, 1, 0, 0])
    assert nested[0][1] and nested[1][1] and nested[0][0] == orders([1, 2, 3], [0, 0, 0])[0][0] != orders([2, 1, 3], [0, 0, 0])[0][0]
    assert not orders([1, 2, 3, 1, 3, 2], [0] * 6)[0][1]
    straddling = orders([1, 7, 2, 8, 3], [0, 1, 0, 1, 0])
    assert straddling[0][1] and not straddling[1][1]
    split = H.class_orders(np.array([1, 1, 2, 2]), np.array([0] * 4), np.array([0, 0, 1, 1]))
    assert not split[0, -1][1] and split[0, 0][1] and split[0, 1][1]
    whole = H.class_orders(np.array([1, 2, 1, 2]), np.array([0] * 4), np.array([0, 1, 0, 1]))
    assert whole[0, -1][1] and whole[0, 0] == split[0, 0] and whole[0, 1] == split[0, 1]


def shop(host, i, items, paragraphs, menu):
    item = "".join(f"<{menu}>Item{k} menu{k}</{menu}>" for k in range(items))
    text = "".join(f"<p>story{i}x{k} about thing{i}y{k} number{i}z{k}</p>" for k in range(paragraphs))
    return f"<html><body><div><ul>{item}</ul></div><div><h2>Head{i} line{i}</h2>{text}</div><div><p>Copyright {host} all rights reserved</p></div></body></html>"


def test_as_many_menu_items_as_paragraphs(spark):
    """Classes that merge a menu with the article are split; the article comes alone for every number of items."""
    rows, want = [], {}
    for h, (k, menu) in enumerate((k, menu) for k in range(1, 9) for menu in ("li", "div")):
        for i in range(6):
            rows.append((len(rows), f"http://shop{h}.org/{i}", shop(f"shop{h}", i, k, k, menu)))
            want[rows[-1][0]] = "\n".join([f"Head{i} line{i}", *(f"story{i}x{j} about thing{i}y{j} number{i}z{j}" for j in range(k))])
    rows += [(r[0], r[1], r[2]) for r in rows[:3]]  # repeated rows
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = [(r.page_id, r.text) for r in H.extract(df).collect()]
    assert len(got) == len(rows) and [(i, t, want[i]) for i, t in got if t != want[i]] == []


def test_classes_out_of_order_are_split_as_brute_force_says():
    """Occurrences and orders of elements and words, counted page by page on one machine, give the classes of `valid_classes`."""
    pages = [shop("h", i, 4, 4, "li") for i in range(5)]
    rows, seqs, names = token_rows(pages)
    bad, worse = set(), set()
    classes = {}
    for r in rows:
        classes.setdefault((r["pages"], r["times"], r["vector"]), []).append(r)

    def steady(tokens):
        runs = set()
        for seq in seqs:
            mine = [t for t in seq if t in tokens]
            n = len(tokens)
            runs |= {tuple(mine[a : a + n]) for a in range(0, len(mine), n)}
        return len(runs) == 1 and len(set(*runs)) == len(tokens)

    for k, v in classes.items():
        if not steady({r["token"] for r in v}):
            bad.add(k)
            worse |= {(k, at) for at, part in H.by_role(v).items() if not steady({r["token"] for r in part})}
    assert any({names[r["token"]] for r in classes[k]} >= {"li", "p"} for k in bad)
    valid = H.valid_classes(rows, len(pages), frozenset(bad), frozenset(worse))
    held = {names[r["token"]] for v in valid for r in v}
    assert {"li", "p", "h2", "Copyright", "Item0", "menu3"} <= held and not any(x.startswith("story") for x in held)
    slot, out, words = H.template([*rows, {"token": 0, "at": 0, "tag": "", "pages": 5, "times": 5, "vector": (), "chars": 1, "links": 0}], frozenset(bad), frozenset(worse))
    assert slot is not None and names[slot] == "div"


def token_rows(pages):
    """Rows of elements and words of pages, their sequences, and names of tokens."""
    import numpy as np

    paths, sums, seqs, names = H.Paths(), {}, [], {}
    for i, page in enumerate(pages):
        nodes, seq = H.nodes(page, paths), []
        below = {}
        for n, _, text, _ in nodes:
            if text:
                for w in text.split():
                    t = int(H.word_tokens(np.array([paths.code[n]]), H.hashed([w]))[0])
                    names[t] = w
                    seq.append((t, paths.code[n], None, len(w)))
                    for m in ancestry(paths, n):
                        below[paths.code[m]] = below.get(paths.code[m], 0) + len(w)
            else:
                names[paths.code[n]] = paths.tag[n]
                seq.append((paths.code[n], paths.code[paths.parent[n]], paths.tag[n], 0))
        seqs.append([t for t, *_ in seq])
        for t in {x[0] for x in seq}:
            mine = [x for x in seq if x[0] == t]
            r = sums.setdefault(t, {"token": t, "at": mine[0][1], "tag": mine[0][2], "pages": 0, "times": 0, "vector": (), "chars": 0, "links": 0})
            r["pages"] += 1
            r["times"] += len(mine)
            r["vector"] += ((i, len(mine)),)
            r["chars"] += below.get(t, 0) if mine[0][2] is not None else sum(x[3] for x in mine)
    return list(sums.values()), seqs, names


def test_quotes_after_any_white_space_belong_to_their_value():
    for n in (0, 3, 70, 500):
        assert H.main_text(f"<p title={' ' * n}\"a > b\">text</p>") == "text"
    began = time.perf_counter()
    H.main_text("<p a=" + " " * 300_000 + "'x" + "\" '" * 100_000)
    assert time.perf_counter() - began < 5
