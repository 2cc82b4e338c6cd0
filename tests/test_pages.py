"""Golden rows of the page fixture: detections, masks, manifest, gate, plan."""

import pytest
from pyspark.errors import PySparkException

from pyspark.sql import functions as F

from veilmark.functions import geometry
from veilmark.operators import detect, redact
from veilmark.plans import fixtures, queries
from veilmark.sources import html
from veilmark.sources.tree import TreeBuilder


@pytest.fixture(scope="module")
def clean(spark, sf):
    return {r["path"]: (r["label"], r["value"]) for r in queries.sanitised_nodes(spark, sf).collect()}


def test_values(clean):
    assert clean["input#login-id"][1] == "KT-88213"
    assert clean["input#secret"][1] == "[REDACTED:PASSWORD]"
    assert clean["input#mail"][1] == "n***@***.net"
    assert clean["input#mobile"][1] == "[PHONE_1]"
    assert clean["dd#debit"][1] == "[REDACTED:CARD_NUMBER]"
    assert clean["dt:nth-of-type(2)"][1] == "Account number"
    assert clean["p#note"][1] == "Write to h***@***.com or call [PHONE_2] about [REDACTED:PAN]."


def test_manifest(spark, sf):
    got = {(r["id"], r["dom_path"], r["masking"], r["detector"]) for r in queries.redaction_manifest(spark, sf).collect()}
    for want in (("PASSWORD_1", "input#secret", "blackbox", "dom:input-type-password"), ("EMAIL_1", "input#mail", "partial", "dom:email"), ("PHONE_1", "input#mobile", "token", "dom:phone"), ("PAN_1", "input#tax-id", "blackbox", "dom:pan"), ("PERSON_NAME_1", "dd#owner", "token", "dom:person-name"), ("BANK_ACCOUNT_1", "dd#acct", "blackbox", "dom:bank-account"), ("IFSC_1", "dd#branch-code", "blackbox", "dom:ifsc"), ("CARD_NUMBER_1", "dd#debit", "blackbox", "dom:cc-number")):
        assert want in got


def test_leak_audit(spark, sf):
    assert {r["name"]: r["verdict"] for r in queries.leak_audit(spark, sf).collect()} == {"email": "ok", "card": "ok", "phone": "ok", "account": "ok", "label": "ok", "password": "ok", "customer id": "known gap"}


def test_gate_refuses(spark):
    raw = fixtures.nodes(spark).selectExpr("snapshot_id", "path", "label", "coalesce(value, text) AS value")
    with pytest.raises(PySparkException, match="raw personal data"):
        redact.refuse_leaks(raw).collect()


def test_plan(spark, sf):
    assert [(r["action"], r["selector"]) for r in queries.plan_rules(spark, sf).orderBy("position").collect()] == [("type", "input#login-id"), ("type", "input#secret"), ("click", "button#enter")]


def test_html(spark):
    page = '<html><head><title>x</title></head><body><div id="a"><p>One</p><p>Two <b>bold</b></p></div><script>no()</script><label for="u">User</label><input id="u" type="text" value="v"><input type="password" value="secret"><dl><dt>Phone</dt><dd>5</dd></dl></body></html>'
    rows = html.nodes(spark.createDataFrame([(1, page), (2, None), (3, "")], "page_id BIGINT, html STRING")).collect()
    got = {r["path"]: r for r in rows}
    assert set(r["page_id"] for r in rows) == {1}
    assert got["div#a > p:nth-of-type(2)"]["text"] == "Two"
    assert got["input#u"]["label"] == "User" and got["input#u"]["role"] == "textbox" and got["input#u"]["value"] == "v"
    secret = [r for r in rows if r["input_type"] == "password"][0]
    assert secret["value"] is None and secret["label"] is None and secret["value_omitted"] == "password"
    assert got["body > dl > dd"]["context_label"] == "Phone"
    assert not any("no()" in (r["text"] or "") for r in rows)


def test_html_row_cap(spark):
    page = "".join(f"<p>{i}</p>" for i in range(450))
    rows = html.nodes(spark.createDataFrame([(1, page)], "page_id BIGINT, html STRING")).collect()
    assert len(rows) == 400 and all(r["truncated"] for r in rows)


def test_texts_of_a_long_page(spark, tmp_path):
    """What a page says is told to its end: the cap is the nodes' own."""
    page = "<body>" + "".join(f"<p>{i}</p>" for i in range(950)) + "</body>"
    spark.createDataFrame([(1, page)], "page_id BIGINT, html STRING").write.parquet(f"{tmp_path}/pages.parquet")
    got = queries.html_texts(spark, str(tmp_path)).collect()
    assert {(r["place"], r["said"]) for r in got} == {(i + 1, str(i)) for i in range(950)} and len(got) == 950


def paths(spark, page):
    return {r["path"]: r for r in html.nodes(spark.createDataFrame([(1, page)], "page_id BIGINT, html STRING")).collect()}


def test_html_without_end_tags(spark):
    """What HTML lets authors leave out: the head's end, list items', cells' and paragraphs'."""
    assert {r["text"] for r in paths(spark, "<html><head><title>x</title><body><p>hello").values()} == {"hello"}
    assert [p for p in paths(spark, "<ul><li>a<li>b<ul><li>c</ul><li>d</ul>")] == ["body > ul > li:nth-of-type(1)", "body > ul > li:nth-of-type(2)", "body > ul > li:nth-of-type(2) > ul > li", "body > ul > li:nth-of-type(3)"]
    cells = paths(spark, "<table><tr><th>Phone<td>5<tr><td>x<td>y</table><p>one<div>two</div><p>three")
    assert [(p.rsplit(" > ", 2)[-2:], r["text"], r["context_label"]) for p, r in cells.items()][:2] == [(["tr:nth-of-type(1)", "th"], "Phone", None), (["tr:nth-of-type(1)", "td"], "5", "Phone")]
    assert cells["body > table > tbody > tr:nth-of-type(2) > td:nth-of-type(2)"]["text"] == "y" and cells["body > p:nth-of-type(2)"]["text"] == "three" and cells["body > div"]["text"] == "two"
    assert {p: r["text"] for p, r in paths(spark, "<head><meta charset=x>Hi<b>there</b>").items()} == {"body": "Hi", "body > b": "there"}
    assert paths(spark, "<div/>in<p>x</p></div>")["body > div > p"]["text"] == "x"


def test_html_names(spark):
    page = """<span id=one>Card</span><span id=two>number <i>here</i></span><input id=a aria-labelledby="one two none" aria-label="no">
      <label>Your <b>name</b> <input id=b placeholder=no></label><label for=c>First</label><label for=c>Second</label><select id=c title=no></select>
      <input id=d placeholder=Hint><input type=submit value=Go><button id=e>Send <i>now</i></button><p id=dup>1</p><p id=dup>2</p>"""
    got = paths(spark, page)
    assert {p: got[p]["label"] for p in ("input#a", "input#b", "select#c", "input#d", "button#e")} == {"input#a": "Card number here", "input#b": "Your name", "select#c": "First Second", "input#d": "Hint", "button#e": "Send now"}
    assert "p#dup" not in got and sum(r["label"] == "Go" for r in got.values()) == 1


def test_html_nodes_need_no_exchange(spark, sf, capsys):
    html.nodes(spark.read.parquet(f"{sf}/pages.parquet")).explain()
    assert "Exchange" not in (plan := capsys.readouterr().out) and "Window" not in plan


def test_forms_are_dealt_and_read_once(spark, tmp_path, capsys):
    """One small file of customers becomes many tasks, and each page is parsed once for all its detections."""
    spark.range(5000).selectExpr("id AS c_custkey", "'Customer#1' AS c_name", "1.5 AS c_acctbal", "'AUTO' AS c_mktsegment").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    assert queries._forms(spark, str(tmp_path)).rdd.getNumPartitions() == 3
    queries.form_detections(spark, str(tmp_path)).explain()
    assert capsys.readouterr().out.count("MapInArrow") == 1


def test_plans_meet_once(spark, tmp_path, capsys):
    """The nodes of a form meet once, on their way to its plan; nothing is kept or joined."""
    spark.range(5000).selectExpr("id AS c_custkey", "'Customer#1' AS c_name", "1.5 AS c_acctbal", "'AUTO' AS c_mktsegment").write.parquet(f"{tmp_path}/customer.parquet")
    queries.form_plans(spark, str(tmp_path)).explain()
    plan = capsys.readouterr().out
    assert plan.count("Exchange hashpartitioning") == 1 and "InMemoryTableScan" not in plan and "Join" not in plan


@pytest.mark.parametrize("threshold", [0.5, 1.0])
def test_page_requests_are_those_of_the_tables(spark, threshold):
    """Within a row: the summary that `sanitise` makes of a page, and the manifest, with the same tokens."""
    odd = """<label for=u>User a.b@example.org</label><input id=u value=b><input id=p type=password value=x><input type=password><input type=password id=q>
      <p>Mail A.B@example.org, c@d.example, +1 415 555 0100 or a.b@example.org</p><textarea>call +1 (415) 555-0100 or +44 20 7946 0958, 1990-01-31</textarea>
      <dl><dt>Account holder</dt><dd>Ann Lee</dd><dt>Card number</dt><dd>4012 8888 8888 1881</dd></dl><input type=email value='a.b@example.org'><input type=email value=''>"""
    long = "".join(f"<p>{i} u{i % 7}@x.example or +1 415 555 {1000 + i % 5}" for i in range(450))
    found = detect.detect_nodes(html.snapshots(spark.createDataFrame([(1, odd), (2, long), (3, "<p>nothing</p>"), (4, None)], "page_id BIGINT, html STRING")), threshold)
    got = {r["session_id"]: r for r in redact.page_requests(found).collect()}
    named = redact.tokens_for(found)
    want = queries._requests_of(found, named, F.col("snapshot_id")).select("session_id", "dom_summary", "redaction_manifest").collect()
    assert got == {r["session_id"]: r for r in want} and {*got} == {"1", "2", "3"}


@pytest.mark.parametrize("threshold", [0.0, 0.5, 0.96, 0.99, 1.0])
def test_any_threshold(spark, threshold):
    """However high the threshold, detection runs, unread passwords are declared, and the gate sees what is left."""
    nodes = fixtures.nodes(spark)
    second = nodes.where("path = 'input#secret'").withColumns({"path": F.lit("input#again"), "node_seq": F.lit(20)})
    nodes = nodes.unionByName(second)
    named = redact.tokens_for(detect.detect_nodes(nodes, threshold))
    listed = redact.manifest(nodes, named).where("type = 'password'").select("id", "dom_path").collect()
    assert sorted(map(tuple, listed)) == [("PASSWORD_1", "input#secret"), ("PASSWORD_2", "input#again")]
    clean = redact.sanitise(nodes, named)
    assert {r["value"] for r in clean.where("path LIKE 'input#secret' OR path = 'input#again'").collect()} == {"[REDACTED:PASSWORD]"}
    assert (redact.violations(clean).count() > 0) == (threshold > 0.9)


def test_whole_pages(spark, sf, tmp_path):
    """Over the table of pages: no node is lost, and the gate has nothing left to refuse."""
    queries.page_sanitised(spark, sf).withColumnRenamed("page_id", "snapshot_id").write.parquet(f"{tmp_path}/clean")
    clean = spark.read.parquet(f"{tmp_path}/clean")
    assert clean.count() == html.nodes(spark.read.parquet(f"{sf}/pages.parquet")).count()
    assert redact.violations(clean).count() == 0


def test_page_with_a_form(spark, tmp_path):
    """A page as a table: what it holds is declared, replaced and planned for."""
    form = "<body><label for=u>User name</label><input id=u value='b'><input id=p type=password value=x><p id=m>Mail a.b@example.org</p><button id=go>Sign in</button>"
    spark.createDataFrame([(7, "https://x.example", form), (8, "https://y.example", "<p>nothing</p>"), (9, None, None)], "page_id BIGINT, url STRING, html STRING").write.parquet(f"{tmp_path}/pages.parquet")
    at = str(tmp_path)
    assert {(r["page_id"], r["type"], r["dom_path"]) for r in queries.page_manifest(spark, at).collect()} >= {(7, "password", "input#p"), (7, "email", "p#m")}
    assert {r["value"] for r in queries.page_sanitised(spark, at).collect()} >= {"[REDACTED:PASSWORD]", "nothing", "Mail a***@***.org"}
    assert [(r["page_id"], r["field"], r["detector"]) for r in queries.page_violations(spark, at).collect()] == [(7, "value", "regex:email")]
    assert [(r["page_id"], r["action"], r["selector"], r["rejection"]) for r in queries.page_plans(spark, at).orderBy("position").collect()] == [(7, "type", "input#u", None), (7, "type", "input#p", None), (7, "click", "button#go", None)]


def test_faces_and_audits(spark, sf):
    nodes, named = queries._named(spark)
    rows = redact.manifest(nodes, named)
    faces = spark.createDataFrame([("bank", 0, [1.0, 2.0, 3.0, 4.0], 0.9)], "snapshot_id STRING, face INT, bbox ARRAY<DOUBLE>, score DOUBLE")
    both = redact.with_faces(rows, faces)
    assert both.count() == rows.count() + 1 and both.where("id = 'FACE_1' AND masking = 'blur'").count() == 1
    assert redact.regions(both).count() == rows.where("bbox IS NOT NULL").count() + 1
    clean = redact.sanitise(nodes, named)
    assert redact.clobbered(clean).count() == 0
    assert redact.clobbered(clean.withColumn("value", F.lit("[PHONE_1]"))).select("path").distinct().count() == 2
    shown = spark.createDataFrame([("hidden", None, 1.0), (None, "none", 1.0), (None, None, 0.0), (None, None, None), ("visible", "block", 0.5)], "v STRING, d STRING, o DOUBLE")
    assert [r[0] for r in shown.select(geometry.shown(F.col("v"), F.col("d"), F.col("o"))).collect()] == [False, False, False, True, True]


def drawn(node):
    """A tree as one line: tag(children), texts in quotes, blank texts left out."""
    kids = [f"'{k}'" if isinstance(k, str) else drawn(k) for k in node.kids if not (isinstance(k, str) and k.isspace())]
    return node.tag + (f"({' '.join(kids)})" if kids else "")


ODD_PAGES = {
    "": "",
    "plain text": "'plain text'",
    "leading text <p>x": "'leading text ' p('x')",
    "<p>one<p>two": "p('one') p('two')",
    "<p>1<div>2</p>3": "p('1') div('2' p '3')",
    "<div><p>a</div>b": "div(p('a')) 'b'",
    "<h1>a<h2>b</h1>c": "h1('a') h2('b') 'c'",
    "<pre>\n\nx</pre>": "pre('\nx')",
    "a<br/>b</br>c</p>d": "'a' br 'b' br 'c' p 'd'",
    "</i>x</table></td>y": "'x' 'y'",
    "<body><p>x<body class=k>y</body>z</html>w": "p('x' 'y' 'z' 'w')",
    "<!-- c --> <!DOCTYPE html> <html> <body>t": "'t'",
    "<ul><li>a<ul><li>b</ul><li>c</ul>": "ul(li('a' ul(li('b'))) li('c'))",
    "<ol><li><div><li>x</div></ol>": "ol(li(div) li('x'))",
    "<dl><dt>a<dd>b<dt>c</dl>": "dl(dt('a') dd('b') dt('c'))",
    "<button>a<button>b": "button('a') button('b')",
    "<form>1<form>2</form>3": "form('1' '2') '3'",
    "<select><option>a<option selected>b<optgroup label=x><option>c</select>d": "select(option('a') option('b') optgroup(option('c'))) 'd'",
    "<select><div>x</div><input>y": "select('x') input 'y'",
    "<textarea>\n<b>x&lt;</textarea>z": "textarea('<b>x<') 'z'",
    "<textarea>never ends": "textarea('never ends')",
    "<iframe><p></iframe>y": "iframe('<p>') 'y'",
    "<p>a<script>if (a<b) '<p>'</script>b": "p('a' script('if (a<b) '<p>'') 'b')",
    "<table><tr><td>1</table>2": "table(tbody(tr(td('1')))) '2'",
    "<table><td>1<tr><td>2": "table(tbody(tr(td('1')) tr(td('2'))))",
    "<table>stray<tr><td>1<b>x</table>y": "'stray' table(tbody(tr(td('1' b('x'))))) 'y'",
    "<table><div>d</div><tr><p>p</p><td>1</table>": "div('d') p('p') table(tbody(tr(td('1'))))",
    "<table><caption>c<tr><th>h<td>d<tbody><tr><td>z</table>": "table(caption('c') tbody(tr(th('h') td('d'))) tbody(tr(td('z'))))",
    "<table><colgroup><col><col>x<tr><td>1</table>": "'x' table(colgroup(col col) tbody(tr(td('1'))))",
    "<table><td>a<table><td>b</table>c</table>d": "table(tbody(tr(td('a' table(tbody(tr(td('b')))) 'c')))) 'd'",
    "<table><tr><td><p>a</td><td>b</tr></table>": "table(tbody(tr(td(p('a')) td('b'))))",
    "<table><form><tr><td>1<input type=hidden></table>": "table(form tbody(tr(td('1' input))))",
    "<p><table><tr><td>x": "p(table(tbody(tr(td('x')))))",
    "<!doctype html><p><table><tr><td>x": "p table(tbody(tr(td('x'))))",
    "<b><p>x</b>y": "b p(b('x') 'y')",
    "<p>a<b>b<i>c</b>d</i>e": "p('a' b('b' i('c')) i('d') 'e')",
    "<p><b>a<p>b": "p(b('a')) p(b('b'))",
    "<b>1<table><td>2</b>3</table>4": "b('1' table(tbody(tr(td('2' '3')))) '4')",
    "<a>1<a>2": "a('1') a('2')",
    "<a href=1><div>x<a href=2>y</div>z": "a div(a('x') a('y')) a('z')",
    "<nobr>a<nobr>b": "nobr('a') nobr('b')",
    "<div>a<svg/>b<svg><g/><p>c</div>d": "div('a' svg 'b' svg(g) p('c')) 'd'",
    "<div><svg/><p>x": "div(svg p('x'))",
    "<svg><title>k</title><foreignObject><div>q</div></foreignObject><![CDATA[a<b]]></svg>r": "svg(title('k') foreignobject(div('q')) 'a<b') 'r'",
    "<math><mi>x</mi><mo>y</math>z": "math(mi('x') mo('y')) 'z'",
    "<ruby>a<rt>b<rp>c</ruby>": "ruby('a' rt('b') rp('c'))",
}


@pytest.mark.parametrize("page", ODD_PAGES)
def test_trees_of_odd_pages(page):
    assert drawn(TreeBuilder.tree(page)) == f"html(head body{'(' + ODD_PAGES[page] + ')' if ODD_PAGES[page] else ''})"


def test_heads():
    for page, want in {"<title>a&amp;<b></title>x": "head(title('a&<b>')) body('x')", "<head><script>a<b</script></head><body>t": "head(script('a<b')) body('t')", "<meta><noscript><p>n</noscript>x": "head(meta noscript('<p>n')) body('x')", "<template><p>t</template>u": "head(template(p('t'))) body('u')", "<link></head><style>s</style>": "head(link style('s')) body"}.items():
        assert drawn(TreeBuilder.tree(page)) == f"html({want})"


def test_deep_pages():
    assert len(TreeBuilder.tree("<div>" * 3000 + "x").kids) == 2


def test_text_outside_elements_is_seen(spark):
    assert {p: r["text"] for p, r in paths(spark, "mail a.b@example.org <p>x</p> or c").items()} == {"body": "mail a.b@example.org or c", "body > p": "x"}
    assert paths(spark, "just text")["body"]["text"] == "just text"


def test_held_values(spark):
    page = """<textarea id=t>\n Line <b> &amp;\n two</textarea><select id=s1><option value=1>One<option value=2 selected>Two</select>
      <select id=s2><optgroup disabled><option>a</optgroup><option disabled>b<option> c  d </select><select id=s3 multiple><option>x</select>
      <select id=s4><option selected>x<option selected>y</select><select id=s5 size=3><option>x</select><select id=s6></select>
      <input id=c type=checkbox><input id=r type=RADIO value=v><input id=f type=file value=x><input id=n type=number value=1x><input id=o type=number value=-1.5e3><input id=l value="w"><input id=p type=PassWord value=x>"""
    got = paths(spark, page)
    held = {"textarea#t": "Line <b> & two", "select#s1": "2", "select#s2": "c d", "select#s3": None, "select#s4": "y", "select#s5": None, "select#s6": None, "input#c": "on", "input#r": "v", "input#f": None, "input#n": None, "input#o": "-1.5e3", "input#l": "w", "input#p": None}
    assert {p: got[p]["value"] for p in held} == held
    assert got["input#p"]["value_omitted"] == "password" and len(paths(spark, f"<textarea id=t>{'x' * 300}</textarea>")["textarea#t"]["value"]) == 201


def test_held_values_are_detected_and_replaced(spark):
    page = "<textarea id=t>write to a.b@example.org</textarea><select id=s name=mail><option>x<option selected>c.d@example.org</select><input id=m type=EMAIL value=odd>"
    nodes = html.snapshots(spark.createDataFrame([(1, page)], "page_id BIGINT, html STRING"))
    named = redact.tokens_for(detect.detect_nodes(nodes))
    assert {(r["path"], r["type"]) for r in named.collect()} == {("textarea#t", "email"), ("select#s", "email"), ("select#s > option:nth-of-type(2)", "email"), ("input#m", "email")}
    assert {r["path"]: r["value"] for r in redact.sanitise(nodes, named).where("path LIKE '%#%' AND path NOT LIKE '%option%'").collect()} == {"textarea#t": "write to a***@***.org", "select#s": "c***@***.org", "input#m": "[EMAIL]"}


def test_roles_and_types(spark):
    acting = ["button", "link", "textbox", "searchbox", "checkbox", "radio", "combobox", "listbox", "menuitem", "menuitemcheckbox", "menuitemradio", "option", "tab", "switch", "slider", "spinbutton"]
    idle = ["tablist", "optionality", "buttonish", "list", "Button"]
    page = "".join(f"<div id=x_{r} role='{r} other'>t</div>" for r in [*acting, *idle]) + "<details id=d>t</details><div id=none role=' '>t</div><p id=e contenteditable>t</p>"
    got = paths(spark, page)
    assert {r for r in [*acting, *idle] if got[f"div#x_{r}"]["interactive"]} == {*acting}
    assert all(got[f"div#x_{r}"]["text"] is None for r in acting) and got["div#x_tablist"]["text"] == "t" and got["details#d"]["interactive"] and got["p#e"]["text"] is None
    assert got["div#none"]["role"] is None and got["div#x_list"]["role"] == "list"
    got = paths(spark, "<input id=a type=EMAIL><input id=b type=odd><input id=c><button id=d type=submit>x</button><input id=e type=Range><svg id=v>t</svg>")
    assert {p.split("#")[1]: (r["input_type"], r["role"]) for p, r in got.items()} == {"a": ("email", "textbox"), "b": ("text", "textbox"), "c": ("text", "textbox"), "d": (None, "button"), "e": ("range", "slider"), "v": (None, None)}
    assert got["svg#v"]["text"] is None and got["svg#v"]["media"] == "svg"


def test_a_label_stands_for_one_control(spark):
    got = paths(spark, "<label>Both <input id=a><input id=b></label><label for=''>None <input id=c></label><label>Hid <input id=h type=hidden><input id=d></label><label for=e>One</label><select id=e></select>")
    assert {p.split("#")[1]: r["label"] for p, r in got.items() if "#" in p} == {"a": "Both", "b": None, "c": None, "h": None, "d": "Hid", "e": "One"}


def test_a_break_stands_between(spark):
    assert paths(spark, "<b>Name</b><br><i>x</i><b>Phone</b><i>y</i>")["body > i:nth-of-type(1)"]["context_label"] is None
    assert paths(spark, "<b>Name</b><br><i>x</i><b>Phone</b><i>y</i>")["body > i:nth-of-type(2)"]["context_label"] == "Phone"
