"""Hosts that rules decide a part of are seeds by that part."""

from codexa.llm import urls


def test_a_part_of_a_hosts_pages_makes_it_a_seed(spark):
    link = '<a href="http://far.net/x">x</a>'
    rows = [(i, f"http://good.net/{'de' if i == 0 else 'fr'}/{i}", link) for i in range(5)]
    rows += [(10, "http://far.net/x", ""), (11, "http://bad.com/en/1", "")] + [(i, f"http://bad.com/fr/{i}", '<a href="http://other.xyz/">x</a>') for i in range(12, 16)]
    rows += [(20, "http://to.bad.xyz/1", '<a href="http://bad.com/">x</a>'), (21, "http://other.xyz/1", "")]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    # one of five pages each: trust goes on to far.net, distrust back to to.bad.xyz and stays with bad.com
    assert got[1].trust > 0 and got[1].verdict == "allow" and got[10].trust > 0 and got[10].verdict == "allow"
    assert got[12].distrust > 0 and got[12].verdict == "block" and got[20].verdict == "block"
    assert got[21].trust == got[21].distrust == 0 and got[21].verdict == "allow"
