import pytest

from quernel.llm.residue import classify_messages, message_class, residue

SCHEMA = "fetch_id bigint, url string, title string, content string, markdown string, text string, id string, host string, hash string"


def run(spark, bodies, title="A title"):
    rows = [(i, f"https://h{i}.example/p", title, b, None, None, "x", "y", "z") for i, b in enumerate(bodies)]
    return {r.fetch_id: r.why for r in residue(spark.createDataFrame(rows, SCHEMA)).collect()}


REAL = "The drain worker reads Notes from queue.tsv before the morning report."


def test_cases(spark):
    bad = [
        "# Error 404\n\nThe page you asked for does not exist.\n\nRay abc12345",
        "Please enable JavaScript to view this page.",
        "Lorem ipsum dolor sit amet consectetur. Tempor labore magna.",
        "Replace this paragraph with your own words. Title goes here.",
        "Dear {{ first_name }}, welcome. " + REAL,
        "Die gewünschte Seite existiert nicht oder wurde verschoben.",
        "请启用JavaScript后继续浏览。",
        "# Der Abgleich überspringt 9 Artikel, z. B. ragged-valley. Und mehr\n\nBitte aktivieren Sie JavaScript, um fortzufahren.",
    ]
    good = [
        REAL,
        REAL + "\n\nPlease enable JavaScript to view the comments.",
        "In the draft, `<%= author %>` stands for a name; the final page shows a person.",
        "The syntax looks like this:\n\n```html\n<h1>{{ title }}</h1>\n```\n" + REAL,
        'A notice that says "please enable JavaScript" loses half of the visitors, so we removed ours.',
        "We write {a, b} for the pair and [7] for the source, as the older papers do.",
    ]
    got = run(spark, bad + good)
    assert set(got) == set(range(len(bad)))
    assert got[4] == "placeholder" and got[2] == got[3] == "filler" and got[0] == got[1] == "notice"


def test_edges(spark):
    assert run(spark, []) == {}
    assert run(spark, [None, "", " \n", REAL], title=None) == {}
    assert set(run(spark, [REAL, None], title="Notes on ${name}")) == {0}
    long = (REAL + " ") * 20_000
    assert run(spark, [long]) == {}
    rows = [(1, None, None, " ", None, "Access denied. Come back later.", "", "", "")] * 3
    assert [r.fetch_id for r in residue(spark.createDataFrame(rows, SCHEMA)).collect()] == [1]


def test_masked_messages_recur(spark):
    rows = [(i, f"h{i % 3}", f"Request failed to load at {i}:00 on 2026-01-{i:02d}.") for i in range(1, 7)]
    known = classify_messages(spark.createDataFrame(rows, "id bigint, host string, body string")).collect()
    assert len(known) == 1 and known[0].times == 6 and known[0].hosts == 3


@pytest.mark.parametrize("text", ["", "   ", "!!!", "# ", "\u0000", "🚀🚀"])
def test_class_of_anything(text):
    assert message_class(text) in ("own", "notice", "weak", "filler", "furniture")


@pytest.mark.parametrize(
    ("text", "kinds"),
    [
        # no table holds these; those a review named were known when the rules were written
        *[(t, ("notice",)) for t in (
            "Page not found", "The long-lost page was not found.", "Error #: page-not-found", "This domain has been parked", "Your browser is out of date", "Proxy error", "Database connection error", "Under construction",
            "Sorry, we can't find the page you are looking for.", "Access to this resource is forbidden.", "Your session has expired, please log in again.", "You must enable JavaScript to use this application.",
            "This account has been suspended or is no longer available.", "The server took too long to respond.", "Too many requests, please slow down.",
        )],
        *[(t, ("filler",)) for t in ("Your tagline here", "Aenean lacinia bibendum nulla sed consectetur.", "Replace this sample text with your own.", "Vivamus sagittis lacus vel augue laoreet rutrum faucibus dolor auctor.")],
        *[(t, ("maybe",)) for t in ("Pagina non trovata", "Deze pagina bestaat niet", "Strona nie istnieje", "Sayfa bulunamadı", "Página não encontrada", "ページが見つかりません")],
        *[(t, ("own",)) for t in (
            "This document does not exist in the archive of Vienna.", "We cannot open the tomb without permission from the museum.", "Cookies must cool on a wire rack before you serve them.", "The script requires two actors.",
            "Loading a kiln takes patience.", "The bridge was closed for maintenance in March while the river froze.", "Her request was denied by the abbot, and the letters were burned.", "Visitors need a permit to enter the reserve.",
            "The play has no script and relies on its audience.", "Forbidden fruit ripens early in the southern valleys.",
        )],
    ],
)
def test_classes_of_other_texts(text, kinds):
    assert message_class(text) in kinds


def test_long_notices_and_quotes():
    long = "We are sorry, but the page you are looking for could not be found. " * 1
    assert message_class("Sorry, " + "the page or file or document or image or video or link " * 8 + "could not be found on this server.") == "notice"
    assert message_class('The word "' + "error " * 200 + '" stands here as a joke between monks.') == "own"
    assert message_class(long) == "notice"


def test_recurrence_decides_on_what_rules_cannot(spark):
    """A phrase that stands beside what only each page says is told there; the same phrase where nothing else stands is a notice."""
    told = "Die Anfrage war nicht verfügbar."
    rows = [(i, f"https://h{i}.example/p", "t", f"Page number {'abcdefghij'[i]} has words of its own about the harbour.\n\n{told}", None, None, "x", "y", "z") for i in range(8)]
    rows += [(100 + i, f"https://g{i}.example/p", "t", "Diese Seite wurde nicht gefunden.\n\nZum Anfang, bitte hier entlang.", None, None, "x", "y", "z") for i in range(4)]
    got = {r.fetch_id for r in residue(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {100, 101, 102, 103}


def test_placeholders_in_titles_of_pages_without_messages(spark):
    assert run(spark, ["```\ncode only\n```"], title="Notes on ${name}") == {0: "placeholder"}
    assert run(spark, ["```\ncode only\n```"]) == {}
