import zipfile

from codeweft.operators import history
from codeweft.sources import code, parsers, python_parser, store


def test_folder_and_zip(spark, tmp_path):
    (tmp_path / "p/src").mkdir(parents=True)
    (tmp_path / "p/node_modules").mkdir()
    (tmp_path / "p/src/a.py").write_bytes(b"x = 1 # \xff!\n")
    (tmp_path / "p/src/b.bin").write_text("x")
    (tmp_path / "p/node_modules/c.js").write_text("x")
    rows = code.scan_folder(spark, str(tmp_path / "p")).collect()
    assert [(r.path, r.language, r.content) for r in rows] == [("src/a.py", "python", "x = 1 # !\n")]
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("m/a.go", "package m\n")
        z.writestr("../evil.py", "x")
    (tmp_path / "broken.zip").write_bytes(b"no archive")
    got = {(r.archive.rsplit("/", 1)[1], r.path, r.language, r.error) for r in code.scan_zips(spark, str(tmp_path / "*.zip")).collect()}
    assert got == {("z.zip", "m/a.go", "go", None), ("broken.zip", None, None, "unreadable: BadZipFile")}
    assert [r.error for r in code.scan_zips(spark, str(tmp_path / "z.zip"), most=0).collect()] == ["too many members"]


def test_uploads(spark):
    rows = [("./a/b.py", 10, 1), ("../c.py", 10, 2), ("a\\d.js", 10, 3), ("node_modules/e.js", 10, 4), ("f.txt", 10, 5), ("g.go", 3_000_000, 6), ("/h.py", 1, 7), ("i.rs", 1, 8)]
    df = spark.createDataFrame(rows, "path string, size long, ord int")
    assert [r.path for r in code.upload_folder(df).collect()] == ["a/b.py", "a/d.js", "i.rs"] and code.upload_folder(df, most=1).count() == 1
    got = {r.path: r.error for r in code.validate_upload(spark.createDataFrame([("a.zip", 60 * 2**20), ("a.zip2", 1), ("b.py", 1)], "path string, size long")).collect()}
    assert got == {"a.zip": "too large", "a.zip2": "unknown extension", "b.py": None}


def test_git_log(spark, tmp_path):
    lines = ["COMMIT|h1|first|ann|2024-01-01", "3\t1\ta.py", "-\t-\tb.png", "", "COMMIT|h2||bob|2024-01-02", ""]
    df = spark.createDataFrame([("r", k, x) for k, x in enumerate(lines)], "repo string, line_no int, line string")
    got = {r.hash: (r.insertions, r.deletions, r.churn, r.files_changed, r.message, r.author, r.date) for r in code.git_log(df).collect()}
    assert got == {"h1": (3, 1, 4, 2, "first", "ann", "2024-01-01"), "h2": (0, 0, 0, 0, "", "bob", "2024-01-02")}
    assert [r.hash for r in code.git_log(df, most=1).collect()] == ["h1"]
    diff = [("r", "h1", 1, "+def go():"), ("r", "h1", 1, "+++ b/def x"), ("r", "h1", 1, "-func old() {"), ("r", "h2", 2, "+class A:")]
    assert {(r.hash, r.fn_added, r.fn_removed) for r in code.function_deltas(spark.createDataFrame(diff, "repo string, hash string, ord int, line string"), most=1).collect()} == {("h1", 1, 1)}
    (tmp_path / "x/.git").mkdir(parents=True)
    assert code.git_root(str(tmp_path)) == str(tmp_path / "x") and code.git_root(str(tmp_path / "x")) == str(tmp_path / "x") and code.git_root(str(tmp_path / "x/.git")) is None
    assert code.git_totals(str(tmp_path)) == (0, "HEAD")


def test_services_and_edges(spark):
    rows = [
        ("orders-svc/a.py", 'requests.get("http://user-api/x")\nchannel.basic_publish("paid.q")\n'), ("user_api/go.mod", "m"), ("user_api/b.py", "channel.consume('paid.q')"), ("docs/x.md", ""),
        ("docs/sub/package.json", "{}"), ("node_modules/package.json", "{}"), ("top.py", "x"),
    ]
    files = spark.createDataFrame(rows, "path string, content string")
    found = code.services(files)
    assert {(r.service, r.rel_path) for r in found.collect()} == {("user_api", "user_api"), ("orders-svc", "orders-svc")}
    mine = code.with_service(files, found)
    assert {r.path: r.service for r in mine.collect()}["user_api/b.py"] == "user_api" and mine.where("service is null").count() == 4
    assert [(r.source, r.target, r.line_no, r.confidence) for r in code.service_edges(mine).collect()] == [("orders-svc", "user_api", 1, 0.85)]
    assert [(r.source, r.target, r.queue, r.line_no) for r in code.queue_edges(mine).collect()] == [("orders-svc", "user_api", "paid.q", 2)]
    wrapped = spark.createDataFrame([("w/auth/Dockerfile", ""), ("w/auth/a.py", ""), ("w/lib/a.py", "")], "path string, content string")
    assert [(r.service, r.rel_path) for r in code.services(wrapped).collect()] == [("auth", "w/auth")]
    assert {r.service for r in code.with_service(wrapped, code.services(wrapped)).where("path like '%.py'").collect()} == {"auth", None}


PROGRAM = """def f(x, n):
    y = 0
    if x < 0:
        y = n
    else:
        y = x + 1
        z = y
    while n:
        n -= 1
    try:
        w = y
    except ValueError:
        w = 0
    return w
"""


def test_statements_and_slices(spark):
    got = python_parser.statements(PROGRAM, "f")
    assert [(s[0], s[1], s[2], s[4], s[5], s[6], s[7]) for s in got] == [
        ("S1", 1, "entry", [], ["n", "x"], None, None), ("S2", 2, "assign", [], ["y"], None, None), ("S3", 3, "if", ["x"], [], None, None), ("S4", 4, "assign", ["n"], ["y"], "S3", "true"),
        ("S5", 6, "assign", ["x"], ["y"], "S3", "false"), ("S6", 7, "assign", ["y"], ["z"], "S3", "false"), ("S7", 8, "while", ["n"], [], None, None), ("S8", 9, "augassign", ["n"], ["n"], "S7", "true"),
        ("S9", 10, "try", [], [], None, None), ("S10", 11, "assign", ["y"], ["w"], "S9", "try"), ("S11", 13, "assign", [], ["w"], "S9", "except"), ("S12", 14, "return", ["w"], [], None, None),
    ]
    st = spark.createDataFrame([(s[0], s[1], s[4], s[5], s[6], s[7]) for s in got], "id string, line int, reads array<string>, writes array<string>, parent string, branch string")
    trace = spark.createDataFrame([("r", k, line) for k, line in enumerate([2, 3, 4, 8, 9, 8, 10, 11, 14], 1)], "run string, ord int, line int")
    done = history.executed(trace, st)
    order = history.execution_order(done).cache()
    assert [r.id for r in order.orderBy("ord").collect()] == ["S1", "S2", "S3", "S4", "S7", "S8", "S9", "S10", "S12"]
    data, control = history.data_dependencies(done, st), history.control_dependencies(order, st)
    assert ("S10", "y", "S4") in {(r.id, r["var"], r.writer) for r in data.collect()} and {(r.id, r.parent) for r in control.collect()} == {("S4", "S3"), ("S8", "S7"), ("S10", "S9")}
    cut_out = [r.id for r in history.backward_slice(order, st, data, control, "r", "S12", "w").collect()]
    assert cut_out == ["S1", "S3", "S4", "S9", "S10", "S12"]  # neither the loop nor the first y
    assert python_parser.statements("def (", "f") == [] and python_parser.statements(PROGRAM, "g") == []


def test_parameters():
    text = "class A:\n    def m(self, a: int, b: 'X', c: Optional[List[int]] = None, d: str | None = None, e=1, *f): pass\n"
    assert python_parser.parameters(text, "m") == [("a", "int", False), ("b", "'X'", True), ("c", "list", False), ("d", "str", False), ("e", None, False)]
    assert python_parser.parameters("x = 1", "m") is None


def one(rows, **want):
    row = next(r for r in rows if r["name"] == want["name"])
    assert {k: row[k] for k in want} == want, row


def test_python_functions_and_classes():
    text = """
from abc import ABC, abstractmethod
class Base(ABC):
    kind: str = "x"
    @abstractmethod
    def go(self): ...
class Impl(pkg.Base, Generic[T]):
    def __init__(self, how: Base, many=None):
        self.how = how
        self.parts = []
        self.sub = Base()
        super().__init__()
    def go(self, a, b=3):
        def inner(): return helper(7777)
        self.sub.go(); self.stop()
        for x in a:
            if x: inner()
        return Impl(a)
if True:
    async def top(q): await q
"""
    functions, classes = python_parser.parse("p/a.py", text)
    assert [f["name"] for f in functions] == ["go", "__init__", "go", "top"]
    one(functions[2:], name="go", class_name="Impl", calls=["Impl", "go", "helper", "inner", "stop"], call_targets={"go": "Base", "stop": "Impl"}, complexity=3, max_nesting_depth=2, literal_count=1, param_count=2, instantiates=["Impl"], is_method=True)
    one(functions, name="__init__", call_targets={"__init__": python_parser.SUPER})
    one(functions, name="go", is_abstract=True)
    one(classes, name="Base", kind="abstract_class", bases=["ABC"], fields=[{"name": "kind", "type": "str", "is_collection": False}], method_names=["go"])
    fields = [{"name": "how", "type": "Base", "is_collection": False}, {"name": "parts", "type": "", "is_collection": True}, {"name": "sub", "type": "Base", "is_collection": False}]
    one(classes, name="Impl", kind="class", bases=["Base", "Generic[T]"], fields=fields, line_start=7)


def test_java():
    text = """package a;
public interface Pay { void pay(int sum); }
abstract class Base<T> extends Root implements Pay, Comparable<Base<T>> {
    private List<Pay> parts = new ArrayList<>();
    protected Pay how;
    public Base(Pay how) { this.how = how; }
    @Override
    public void pay(int sum) throws IOException {
        if (sum > 42) { for (Pay p : parts) { p.pay(sum); } }
        other(new Card());
    }
    static class Inner {
        int two() { return 2; }
    }
}
"""
    functions, classes = parsers.parse_braces("A.java", text, "java")
    assert [(f["name"], f["class_name"], f["line_start"], f["line_end"]) for f in functions] == [("Base", "Base", 6, 6), ("pay", "Base", 8, 11), ("two", "Inner", 13, 13)]
    one(functions, name="pay", complexity=3, calls=["Card", "other"], max_nesting_depth=2, literal_count=1, param_count=1, instantiates=["Card"])
    one(classes, name="Pay", kind="interface", method_names=["pay"])
    fields = [{"name": "parts", "type": "List<Pay>", "is_collection": True}, {"name": "how", "type": "Pay", "is_collection": False}]
    one(classes, name="Base", kind="abstract_class", bases=["Root"], interfaces=["Pay", "Comparable<Base<T>>"], fields=fields, line_start=3, line_end=15)


def test_scripts():
    text = """export class Shop extends base.Store implements A, B {
  private how: Pay;
  constructor(how) { this.how = how; this.items = []; }
  async buy(n) {
    if (n) { return this.how.pay(n) }
  }
}
const add = async (a, b) => { return sum(a, b) }
function plain(a) { return a ? new Shop(a) : null }
exports.out = function (x) { helper(x) }
test("x", () => { plain(1) })
"""
    functions, classes = parsers.parse_braces("s.ts", text, "typescript")
    assert [(f["name"], f["class_name"]) for f in functions] == [("buy", "Shop"), ("add", None), ("plain", None), ("out", None)]
    one(functions, name="buy", complexity=2, calls=["pay"], max_nesting_depth=1, virtual_module="Shop")
    one(functions, name="plain", complexity=2, instantiates=["Shop"], virtual_module="s.ts")
    fields = [{"name": "how", "type": "Pay", "is_collection": False}, {"name": "items", "type": "", "is_collection": True}]
    one(classes, name="Shop", kind="class", bases=["base.Store"], interfaces=["A", "B"], fields=fields)


def test_go_and_rust():
    go = """package a
type Reader interface {
	Read(p []byte) int
}
type File struct {
	name string
	parts []Part
}
func (f *File) Read(p []byte) int {
	for i := range p { if i > 5 { f.close(); open(i) } }
	return 0
}
func New() *File { return &File{} }
"""
    functions, classes = parsers.parse_braces("a.go", go, "go")
    one(functions, name="File.Read", class_name="File", calls=["open"], complexity=3, max_nesting_depth=2, literal_count=1)
    one(functions, name="New", class_name=None, instantiates=["File"])
    one(classes, name="Reader", kind="interface", method_names=["Read"])
    one(classes, name="File", kind="struct", method_names=[], fields=[{"name": "name", "type": "string", "is_collection": False}, {"name": "parts", "type": "[]Part", "is_collection": True}])
    rust = """pub trait Draw { fn draw(&self) -> u8; }
pub struct Pen { pub ink: Vec<u8>, size: u32 }
impl<T> Draw for Pen {
    fn draw(&self) -> u8 { match self.size { 0 => stop(), _ => self.ink.len() as u8 } }
}
pub async fn run(p: Pen) -> Option<u8> { Some(p.draw()?) }
"""
    functions, classes = parsers.parse_braces("a.rs", rust, "rust")
    one(functions, name="draw", class_name="Pen", calls=["len", "stop"], complexity=2)
    one(functions, name="run", class_name=None, calls=["draw"], complexity=2)
    one(classes, name="Draw", kind="trait", method_names=["draw"])
    one(classes, name="Pen", kind="struct", interfaces=["Draw"], fields=[{"name": "ink", "type": "Vec<u8>", "is_collection": True}, {"name": "size", "type": "u32", "is_collection": False}])


def test_parsing_files(spark):
    rows = [("r/src/m/a.py", "python", "def f(): g()\n"), ("r/b.py", "python", "def ("), ("r/c.md", None, "x"), ("r/d.go", "go", None), ("r/src/m/a.py", "python", "def f(): g()\n")]
    df = spark.createDataFrame(rows, "path string, language string, content string")
    got = {(r.file, r.name, r.module) for r in parsers.parse_functions(df).collect()}
    assert got == {("r/src/m/a.py", "f", "m"), ("r/b.py", "__file__", "r"), ("r/c.md", "__file__", "r"), ("r/d.go", "__file__", "r")}
    assert parsers.parse_classes(df).count() == parsers.parse_functions(df.limit(0)).count() == 0


def test_sessions(spark):
    df = spark.createDataFrame([("u", "2024-01-01 00:00:00"), ("u", "2024-01-01 03:00:00"), ("u", "2024-01-01 06:00:01")], "user string, at string").selectExpr("user", "cast(at as timestamp) as at")
    assert sorted(r.events for r in history.sessions(df, "user", "at").collect()) == [1, 2]


def test_registry_of_sessions(spark, tmp_path):
    from datetime import datetime, timedelta, timezone

    import pytest

    from codeweft.streaming.registry import Registry, idle

    r, at = Registry(spark, str(tmp_path)), datetime(2024, 1, 1, tzinfo=timezone.utc)
    a, b = r.start(at), r.start(at)
    store.store(spark.createDataFrame([(a, "x"), (b, "y")], "session_id string, path string"), str(tmp_path / "files"))
    r.touch(b, at + timedelta(hours=1))
    got = {x.session_id: (x.idle_minutes, x.expired) for x in idle(r.events(), at + timedelta(hours=3, seconds=1)).collect()}
    assert got == {a: (180, True), b: (120, False)}
    assert not idle(r.events(), at + timedelta(hours=3)).where("expired").count()
    assert r.sweep(at + timedelta(hours=3, seconds=1)) == [a]
    assert {x.session_id for x in spark.read.parquet(str(tmp_path / "files")).collect()} == {b}
    for bad, error in ((None, ValueError), (a, KeyError), ("x", KeyError)):
        with pytest.raises(error):
            r.validate(bad)


def test_backward_loc_is_clamped(spark):
    rows = [("r", "b2", "2024-01-03", 5, 0), ("r", "a1", "2024-01-03", 30, 1), ("r", "c3", "2024-01-02", 0, 4), ("r", "d4", None, 2, 0), ("r", "e5", "", 1, 9), ("q", "a", "2024-01-01", 1, 0)]
    df = spark.createDataFrame([(*r, "m") for r in rows], "repo string, hash string, date string, insertions int, deletions int, message string")
    now, want = 20, {}
    for _, h, _, plus, minus in sorted(rows[:5], key=lambda r: (-int((r[2] or "0").replace("-", "") or 0), r[1])):
        now = max(0, now - plus + minus)
        want[h] = now
    got = history.backward_loc(df, spark.createDataFrame([("r", 20), ("q", 9)], "repo string, loc long"))
    assert {r["hash"]: r["loc"] for r in got.where("repo = 'r'").collect()} == want


def test_store_replaces_sessions(spark, tmp_path):
    p = str(tmp_path / "s")
    store.store(spark.createDataFrame([("a", 1), ("b", 1)], "session_id string, x int"), p)
    store.store(spark.createDataFrame([("a", 2)], "session_id string, x int"), p)
    assert {(r.session_id, r.x) for r in spark.read.parquet(p).collect()} == {("a", 2), ("b", 1)}


def test_store_of_a_project(spark, tmp_path):
    from codeweft.operators.classes import ClassGraph

    d = str(tmp_path)
    files = spark.createDataFrame([("a.py", "python", "x"), ("a.py", "python", "x")], "path string, language string, content string")
    f = spark.createDataFrame([("f", "a.py", 1, ["g"], "A"), ("g", "a.py", 5, [], "a.py"), ("g", "b.py", 1, [], "b.py")], "name string, file string, line_start int, calls array<string>, virtual_module string")
    for session in ("s1", "s2", "s1"):
        store.store_all(d, session, files, f)
    assert {r.session_id: r["count"] for r in store.read(spark, d, "calls").groupBy("session_id").count().collect()} == {"s1": 2, "s2": 2}
    store.add_edge(spark, d, "s1", "g", "f")
    store.add_edge(spark, d, "s1", "g", "f")
    assert store.read(spark, d, "calls").where("session_id = 's1'").count() == 4
    c = spark.createDataFrame([("r", "A", "class", ["B", "Gone"], [], [("x", "B", False)], ["m"]), ("r", "B", "class", [], [], [], [])], "repo string, name string, kind string, bases array<string>, interfaces array<string>, fields array<struct<name:string,type:string,is_collection:boolean>>, method_names array<string>")
    m = spark.createDataFrame([("r", "m", "A", ["k"], ["B"])], "repo string, name string, class_name string, calls array<string>, instantiates array<string>")
    store.store_class_graph(d, "s1", ClassGraph(c, m))
    assert [(r.child, r.parent) for r in store.read(spark, d, "inherits").collect()] == [("A", "B")] and store.read(spark, d, "unresolved").first().parents == ["Gone"]
    assert store.repeated_keys(spark, d).count() == 0
    store.delete_session(spark, d, "s2")
    assert {r.session_id for r in spark.read.parquet(d + "/functions").collect()} == {"s1"}


def test_store_of_runs(spark, tmp_path):
    d = str(tmp_path)
    st = spark.createDataFrame([("a.py::f", s[0], s[1], s[2], s[3], s[4], s[5], s[6], s[7]) for s in python_parser.statements(PROGRAM, "f")], "function_id string, id string, line int, kind string, source string, reads array<string>, writes array<string>, parent string, branch string")
    store.store_statements(d, st)
    store.store_statements(d, st)
    assert store.read(spark, d, "statements").count() == 12 and store.read(spark, d, "control_deps").count() == 6
    run = spark.createDataFrame([("r1", "a.py::f", '{"x": 1}', "ok", None)], "run_id string, function_id string, inputs string, status string, error string")
    done = spark.createDataFrame([("r1", 0, "S1"), ("r1", 1, "S2")], "run_id string, ord long, id string")
    deps = spark.createDataFrame([("r1", "S1", "S2", "x"), ("r1", "S1", "S2", "x")], "run_id string, from_id string, to_id string, variable string")
    for _ in range(2):
        store.store_run(d, run, done, deps)
    assert [store.read(spark, d, t).count() for t in ("runs", "executed", "data_deps")] == [1, 2, 1]


def test_stream_of_sessions(spark, tmp_path):
    from codeweft.streaming.sessions import live_sessions

    rows = [("u", "2024-01-01 00:00:00"), ("u", "2024-01-01 01:00:00"), ("v", "2024-01-02 00:00:00")]
    spark.createDataFrame(rows, "user string, at string").selectExpr("user", "cast(at as timestamp) as at").write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("user string, at timestamp").parquet(str(tmp_path / "in"))
    q = live_sessions(s, "user", "at").writeStream.format("memory").queryName("ended").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.user, r.events) for r in spark.table("ended").collect()] == [("u", 2)]
