"""Elements of pages and what is worked out on them."""

import json

import pytest
from pyspark.sql import functions as F

from gleaner.sources import page_steps as steps
from gleaner.sources import nodes as sources
from gleaner.sources.nodes import MAX_TEXT, elements, ended, nodes

PAGE = """<html><head><title>Homes</title><meta property="og:title" content="2 bedroom flat for sale"><link rel="canonical" href="https://a.example/p">
<script type="application/ld+json">{"@graph":[{"@type":"Organization","name":"Agency"},{"@type":"House","name":"Elm","offers":[{"price":250000,"priceCurrency":"GBP"}],"address":{"streetAddress":"1 Elm Road","postalCode":"YO1 1AA"},"numberOfRooms":3,"image":["https://a.example/1.jpg"]}]}</script>
<script>window.__INITIAL_STATE__ = {"list":[{"id":1,"price":"£1,250 pcm","bedrooms":2,"address":"x}"}]};</script></head><body>
<div itemscope itemtype="https://schema.org/Apartment"><span itemprop="name">Oak</span><span itemprop="price" content="99">99</span></div>
<ul><li class="card b"><h3>Elm</h3><a href="/property/elm-1">£250,000</a> 3 bed house, Elm Road YO1 1AA</li><li class="b card"><h3>Oaks</h3><a href="/property/oak-2">£180,000</a> 2 bed flat, Oak Road</li></ul>
<div class="gallery"><img src="/a.jpg"><img data-src="/b.jpg" srcset="/b2.jpg 2x"></div><a href="mailto:a@b.example?subject=x">m</a><a href="tel:+44 1904 123456">t</a><a rel="next" href="?page=2">Next</a>
<select name="location"><option value="york">York</option></select><p><b>unclosed"""


@pytest.fixture(scope="module")
def page(spark):
    pages = spark.createDataFrame([(1, PAGE, "https://a.example/list/"), (2, "", "https://a.example/"), (3, None, None), (4, "<p><b>x<li>", "https://a.example/")], "page_id long, html string, url string")
    return nodes(pages).cache(), pages


def test_elements_end_where_their_parent_does():
    rows = [(tag, parent, last, visible) for _, parent, last, tag, _, _, visible in elements("<ul><li>a<li>b<i>c</ul><p>d<p>e<div>f</div><br>g</nope><td>h<td>i")]
    assert rows == [("ul", -1, 3, "abc"), ("li", 0, 1, "a"), ("li", 0, 3, "bc"), ("i", 2, 3, "c"), ("p", -1, 4, "d"), ("p", -1, 5, "e"), ("div", -1, 6, "f"), ("br", -1, 7, ""), ("td", -1, 8, "h"), ("td", -1, 9, "i")]
    assert [*elements(None)] == [*elements("")] == [*elements("no tags")] == []
    deep = [*elements("<div>" * 3000 + "x")]
    assert len(deep) == 3000 and deep[0][2] == 2999


def test_text_is_kept_up_to_a_size_and_whole_where_it_is_data():
    long = "y" * (MAX_TEXT + 1)
    rows = {tag: (text, visible) for _, _, _, tag, _, text, visible in elements(f"<b>{long}</b><title>{long}</title><i itemprop=d>{long}</i><u> a <style>s</style>\n b </u>")}
    assert rows["b"] == (None, None) and rows["title"][0] == rows["i"][0] == long and rows["u"] == (" a s\n b ", "a b")


@pytest.mark.parametrize("cut", [1, 7, 40])
def test_a_page_in_pieces_is_that_page(monkeypatch, cut):
    monkeypatch.setattr(sources, "CHUNK", 3 * cut)
    pieces = [PAGE[at : at + cut] for at in range(0, len(PAGE), cut)]
    assert sorted(ended([None, *pieces]), key=lambda e: e[0]) == [*elements(PAGE)]


def test_pieces_meet_in_the_order_of_their_places(spark):
    rows = [(k, at, PAGE[at : at + 99]) for k in (5, 6) for at in range(0, len(PAGE), 99)] + [(7, 1, "</b>"), (7, 0, "<b>x"), (7, 2, None)]
    own = nodes(spark.createDataFrame(rows, "page_id int, place int, html string").repartition(7), place="place").drop("attrs", "visible")
    whole = nodes(spark.createDataFrame([(5, PAGE), (6, PAGE), (7, "<b>x</b>")], "page_id int, html string")).drop("attrs", "visible")
    assert sorted(map(tuple, own.collect()), key=lambda r: r[:2]) == sorted(map(tuple, whole.collect()), key=lambda r: r[:2])


def test_a_long_page_is_not_held_by_its_worker():
    page, most = sources._Elements(), 0
    page.feed("<html><body><ul>")
    for i in range(20_000):
        page.feed(f"<li>part {i}<b>x</b>")
        most = max(most, len(page.texts))
        page.taken()
    assert most < 5_000 and page.count == 40_003 and len(page.open) < 6


def test_steps_on_one_page(page):
    own, pages = page
    linked = steps.linked_listings(own).collect()
    assert [(r.title, r.price, r.address, r.postcode, r.bedrooms, r.images) for r in linked] == [("Elm", "GBP250000", "1 Elm Road, YO1 1AA", "YO1 1AA", "3", ["https://a.example/1.jpg"])]
    assert [r.record for r in steps.marked_up(own).collect()] == [{"name": "Oak", "price": "99"}]
    assert [(r.title, r.price, r.url, r.bedrooms, r.postcode) for r in steps.card_listings(own).orderBy("ord").collect()] == [("£250,000", "£250,000", "/property/elm-1", "3", "YO1 1AA"), ("Oaks", "£180,000", "/property/oak-2", "2", None)]
    assert [r.image for r in steps.gallery(own, pages).orderBy("place").collect()] == ["https://a.example/a.jpg", "https://a.example/b.jpg", "https://a.example/b2.jpg"]
    assert {(r.field, r.value) for r in steps.page_contacts(own).collect()} == {("emails", "a@b.example"), ("phones", "+44 1904 123456"), ("names", "Agency")}
    assert [(r.page_id, r.next_url) for r in steps.next_page(own, pages).collect()] == [(1, "https://a.example/list/?page=2")]
    assert [(r.name, r.value, r.label) for r in steps.place_options(own).collect()] == [("location", "york", "York")]
    graph = steps.open_graph(own).collect()
    assert [(r.title, r.bedrooms, r.propertyType, r.url, r.price) for r in graph] == [("2 bedroom flat for sale", "2", "flat", "https://a.example/p", "99")]
    sets = steps.embedded_sets(own).collect()
    assert [(r.source, r.score, r.path, r.n) for r in sets] == [("inline:window.__INITIAL_STATE__", 4, "list", 1)]
    assert [(r.page_id, r.strategy, json.loads(r.raw)["id"]) for r in steps.first_strategy(own).collect()] == [(1, "embedded", 1)]


def test_each_page_has_its_first_strategy_and_a_small_plan(spark):
    card = '<li class="c"><h3>Card {0}</h3> £1,{0}00 3 bed house</li>'
    marked = '<div itemscope itemtype="https://schema.org/House"><b itemprop="name">Oak</b><i itemprop="price">5</i></div>'
    linked = '<script type="application/ld+json">[{"@type":"House","name":"B"},{"@type":"House","name":"A"}]</script>'
    state = '<script>window.__NUXT__ = [{"id":2,"price":1,"beds":1,"address":"x"},{"id":1}]</script>'
    cards = card.format(2) + card.format(1)
    pages = [(1, state + linked + marked + cards), (2, linked + marked + cards), (3, marked + cards), (4, cards), (5, "<p>none")]
    rows = steps.first_strategy(nodes(spark.createDataFrame(pages, "page_id int, html string")))
    got = [(r.page_id, r.strategy, r.pos) for r in rows.orderBy("page_id", "pos").collect()]
    assert got == [(1, "embedded", 0), (1, "embedded", 1), (2, "linked", 0), (2, "linked", 1), (3, "marked up", 0), (4, "cards", 0), (4, "cards", 1)]
    assert [json.loads(r.raw)["title"] for r in rows.where("page_id in (2, 4)").orderBy("page_id", "pos").collect()] == ["B", "A", "Card 2", "Card 1"]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "collect_list" not in plan


def rows_of(spark, html):
    return nodes(spark.createDataFrame([(1, html)], "page_id int, html string"))


def test_cards_need_company_and_a_link_where_prices_abound(spark):
    card = '<li class="c"><h2>Long enough {0}</h2> £1,{0}00 <a href="/x{0}">a</a></li>'
    many = '<div class="m">£1 £2 £3 £4 £5 and more words {}</div>'
    better = '<p class="d">£9,000 3 bed house, 1 Elm Road</p>' * 2
    pages = [card.format(1), card.format(1) + card.format(2), f"<select>{card.format(1)}{card.format(2)}</select>", many.format("") * 2, many.format('<a href="/details/1">x</a>') * 2, card.format(1) * 3 + better]
    rows = steps.cards(nodes(spark.createDataFrame([*enumerate(pages)], "page_id int, html string"))).collect()
    assert {i: sum(r.page_id == i for r in rows) for i in range(6)} == {0: 0, 1: 2, 2: 0, 3: 0, 4: 2, 5: 2}
    assert {r.visible[:6] for r in rows if r.page_id == 5} == {"£9,000"}


def test_titles_of_cards(spark):
    card = lambda inside: f'<li class="c">{inside} £1,000 here are words</li>'
    got = [r.title for r in steps.card_listings(rows_of(spark, card('<a href="/property/12-elm_house?x"></a>') + card('<h1>.st0 { x }</h1><img alt="3 bed property in York, UK">') + card('<a href="/for-sale">Link text</a>') + card("") + card('<h4 class="property-address">5 Oak Way</h4>'))).orderBy("ord").collect()]
    assert got == ["Elm House", "York, UK", "Link text", "£1,000 here are words", "5 Oak Way"]


def test_one_labelled_picture_is_not_a_gallery(spark):
    html = '<div class="slider"><img src="/1.jpg"></div><img src="/2.jpg" style="background:url(/no.jpg)"><img src="/logo.png"><a href="/3.jpg">x</a><source srcset=">768:https://c.example/4.jpg , >9:https://c.example/5.jpg">'
    pages = spark.createDataFrame([(1, html, "https://a.example/")], "page_id int, html string, url string")
    assert [r.image for r in steps.gallery(nodes(pages), pages).orderBy("place").collect()] == ["https://a.example/1.jpg", "https://a.example/2.jpg", "https://c.example/4.jpg", "https://c.example/5.jpg"]


NEXT = [
    ('<a href="/z" class="next">x</a>', None), ('<div class="pagination"><a class="next" href="/a">x</a></div>', "/a"), ('<div class="pagination"><span class="next"><a href="/b">x</a></span></div>', "/b"),
    ('<span class="next"><div class="pagination"><a href="/c">x</a></div></span>', None), ('<a aria-label="Next page" href="/d">x</a><a rel="next" href="/e">x</a>', "/e"), ('<a rel="next">x</a><a class="next_page" href="/f">x</a>', "/f"),
    ('<div class="pagination"><a href="?page=3">3</a></div>', "/?page=3"), ('<a>next</a><a href="/g"> Next Page </a>', "/g"), ('<a href="/h">next one</a>', None),
]


def test_next_page(spark):
    pages = spark.createDataFrame([(i, html, "https://a.example/") for i, (html, _) in enumerate(NEXT)], "page_id int, html string, url string")
    got = {r.page_id: r.next_url for r in steps.next_page(nodes(pages), pages).collect()}
    assert got == {i: f"https://a.example{want}" for i, (_, want) in enumerate(NEXT) if want}


def test_repeated_selectors_take_short_texts_and_no_class(spark):
    card = "<div><p class='c'>£1,000</p></div>"
    page = "<html><body class='all'>" + "<i>word </i>" * 2000 + card * 3 + "<p class='c'>1,000 pcm</p></body></html>"
    assert sorted(map(tuple, steps.repeated_selectors(rows_of(spark, page)).collect())) == [(1, "div.", 3), (1, "p.c", 3)]


def test_linked_data_of_odd_shapes(spark):
    data = [{"@type": ["Thing", "Offer"], "offers": {"priceCurrency": "GBP"}, "address": "12 Elm", "image": {"url": "u"}, "floorSize": {"value": 80.5}, "numberOfBedrooms": 0, "numberOfRooms": 4}, {"@type": "RealEstateAgent", "price": 1}, {"price": 0, "beds": 1, "address": {}, "name": "n", "id": 1, "author": [{"name": "A"}, "text", {"telephone": "1", "contactPoint": [{"email": "e"}]}]}, 5, None]
    rows = steps.linked_listings(rows_of(spark, f'<script type="application/ld+json">{json.dumps(data)}</script><script type="application/ld+json">{{broken</script>')).orderBy("at").collect()
    assert [(r.title, r.price, r.address, r.images, r.sqft, r.bedrooms, r.propertyType) for r in rows] == [(None, "GBP", "12 Elm", ["u"], "80.5", "4", "Thing,Offer"), ("n", None, None, [], None, None, None)]
    assert rows[1].contact.asDict() == {"names": ["A"], "emails": ["e"], "phones": ["1"]}


def test_no_pages(spark):
    own = nodes(spark.createDataFrame([], "page_id int, html string"))
    assert steps.first_strategy(own).count() == 0 == steps.cards(own).count() and own.where(F.col("tag") == "a").count() == 0


def test_the_cascade_counts_what_is_written(spark, tmp_path):
    from gleaner.plans.pages import strategy_cascade

    spark.range(9).selectExpr("id as p_partkey", "concat('part ', id) as p_name", "cast(id % 3 + 3 as int) as p_size", "id + 900.5 as p_retailprice").write.parquet(f"{tmp_path}/part.parquet")
    rows = strategy_cascade(spark, str(tmp_path))
    assert sorted(map(tuple, rows.collect())) == [("embedded", 1, 3), ("linked", 2, 2)]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "MapInPandas" not in plan


def test_the_first_options_are_not_gathered(spark):
    more = "".join(f"<option value={i}>{i}" for i in range(300))
    rows = steps.place_options(rows_of(spark, f"<select name=Area>{more}</select><select name=Town><option value=x>x</select>"))
    assert [(r.place, r.name, r.value) for r in rows.orderBy("place").collect()] == [(i, "area", str(i)) for i in range(steps.MAX_OPTIONS)]
    assert "collect_list" not in rows._jdf.queryExecution().optimizedPlan().toString()


def test_pages_of_parts_are_not_gathered(spark, tmp_path):
    """A piece for each part and list item, whatever a page holds; parts without a name or price are no cards."""
    from gleaner.plans import pages

    rows = [(i, None if i == 8 else f"part {i}", 4 if i < 20 else 5, None if i == 12 else 1900.5) for i in range(24)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    made = pages._pages(spark, str(tmp_path))
    assert "collect_list" not in made._jdf.queryExecution().optimizedPlan().toString()
    assert made.where("html is not null").count() == 22 + 19 + 2 * 3
    ids = [str(i) for i in range(20) if i != 12]
    assert [(r.page_id, r.n, r.ids) for r in pages.page_embedded(spark, str(tmp_path)).collect()] == [(4, 19, ",".join(ids))]


def test_counts_of_records_are_written(spark, tmp_path):
    from gleaner.plans import pages

    spark.range(8).selectExpr("id as p_partkey", "concat('part ', id) as p_name", "cast(id % 2 + 4 as int) as p_size", "id + 900.5 as p_retailprice").write.parquet(f"{tmp_path}/part.parquet")
    rows = pages.page_records(spark, str(tmp_path))
    assert "Join" not in rows._jdf.queryExecution().optimizedPlan().toString()
    assert {r.kind: r.n for r in rows.where("page_id = 4").collect()} == {"card": 4, "linked": 1, "open graph": 1, "image": 3, "embedded": 1, "contact": 8, "next page": 1, "place": 2}
