from sheafline.llm import emails as M

SENDER = ("Ann Bell", "ann.bell@acme.test")


def own(text=None, html=None):
    return sorted(M.new_lines(text, html, *SENDER))


def test_prefixed_interleaved_and_signature():
    text = "Hi Bo,\nOn 2026-01-02 10:00, Bo Ray <bo@x.test> wrote:\n> one\n> which goes on for quite a while until the line is full and\nwraps here.\n\nMy answer.\n\n> two\nMore.\n\nBest regards,\nAnn\n-- \nDesk, Acme\ntel 555-0100 | ann.bell@acme.test\n\nIf you received it in error, please tell\nus.\n"
    assert own(text) == [1, 6, 8]


def test_unset_quote_takes_the_rest():
    text = "Thanks, noted.\n\n-----Original Message-----\nFrom: Bo Ray <bo@x.test>\nSent: 2026-01-02\nTo: ann.bell@acme.test\nSubject: S\n\nOn 2026-01-01 09:00, Ann Bell <ann.bell@acme.test> wrote:\n> old\nBo's answer\n"
    assert own(text) == [1]


def test_decoys_stay():
    text = "On Monday we wrote: nothing has changed.\n-- verbose prints more.\nOriginal message counts are in column B.\nI never sent from my phone, so no.\nThanks, that is the list.\nSubject: to approval, we start.\n"
    assert own(text) == [1, 2, 3, 4, 5, 6]


def test_wrapped_intro_and_languages():
    for intro in ("Le 2026-01-02 10:00, Bo Ray a écrit :", "Am 2026-01-02 10:00 schrieb Bo Ray:", "El 02/01/2026 10:00, Bo Ray escribió:", "Bo Ray <bo@x.test> skrev 2026-01-02 10:00:", "* Bo Ray [2026-01-02 10:00]:", "On Fri, 02 Jan 2026, Bo Ray\n<bo@x.test> wrote:"):
        assert own(f"Yes.\n{intro}\n> a\nNo.\n") == [1, len(intro.split("\n")) + 3], intro


def test_html_containers():
    html = "<html><style>p{}</style><body><p>Yes.</p><p>On 2026-01-02 10:00, Bo Ray</p><p>&lt;bo@x.test&gt; wrote:</p><blockquote><p>old</p><p>older</p></blockquote><p>No.</p><div class='q'>again<br>quoted<br></div><p>Ann</p></body></html>"
    assert own(None, html) == [1, 6]
    assert M.html_text("<p>a&nbsp;&#233;&amp;</p><script>x</script><br><br><br>b") == "a é&\n\nb"


def test_edges(spark):
    assert own(None, None) == [] and own(" \n", None) == [] and own("", "<p></p>") == []
    assert own("x " * 200_000) == [1]
    rows = [(1, None, None, None, None, 7), (2, "a\n\n> b", None, None, None, 7), (2, "a\n\n> b", None, None, None, 7), (3, " ", "<p>c</p><p>Sent from my phone</p>", None, None, 7)]
    df = spark.createDataFrame(rows, "email_id long, text string, html string, from_name string, from_address string, line_no int")
    assert sorted(map(tuple, M.old_lines(df).collect())) == [(2, 2), (3, 2)]
    assert M.old_lines(df.limit(0)).count() == 0
    assert {r.email_id: r.new_text for r in M.newly_written(df).collect()} == {1: "", 2: "a", 3: "c"}
    assert sorted(map(tuple, M.old_lines(df.select("email_id", "text")).collect())) == [(2, 2)]


def test_quotes_nest():
    tree = M.parse("> > Deep.\n> Up.\nme", None)
    quote = tree.children[-2]
    assert quote.kind == "quote" and quote.children[0].children[-2].kind in ("quote", "authored")
    assert M.new_text("> > Deep.\n> Up.\nme", None) == "me"
