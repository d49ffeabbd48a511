import pytest
from pyspark.sql import functions as F

from graphlens.operators import context
from graphlens.sources import documents

CS = """namespace A.B;
// class Not : Controller {
[Route("api/[controller]")]
public class OrdersController : ControllerBase {
    [HttpGet("{id}")]
    public async Task<IActionResult> Get(int id) { return Ok("class X {"); }
    [HttpPost]
    public IActionResult Add() { services.AddScoped<IRepo, Repo>(); return Ok(); }
}
public class Plain { }
"""
NG = """
@Component({ selector: 'app-x', templateUrl: './x.html', styleUrls: ['./x.css', './y.css'] })
export class XComponent implements OnInit {
  @Input() item: string; @Output() done = new EventEmitter();
  private api = inject(ApiService);
  constructor(private svc: DataService, readonly http: HttpClient) {}
}
@Injectable({ providedIn: 'root' }) export class DataService {}
@Pipe({ name: 'short' }) export class ShortPipe {}
@Injectable() export class AuthGuard implements CanActivate {}
const routes = [{ path: 'a', component: XComponent, canActivate: [AuthGuard] }];
"""


def of(reader, text):
    return [(k, n, d, o) for k, n, _, d, o in documents.READERS[reader][0](text)]


def test_csharp():
    got = of("csharp", CS)
    assert got == [("class", "OrdersController", "ControllerBase", "A.B"), ("endpoint", "api/orders/{id}", "GET", "OrdersController.Get"), ("endpoint", "api/orders", "POST", "OrdersController.Add"), ("class", "Plain", None, "A.B"), ("registration", "IRepo", "scoped", "Repo")]


def test_components():
    got = of("components", NG)
    assert [x for x in got if x[0] in documents.DECORATORS.values()] == [("component", "XComponent", "app-x", None), ("service", "DataService", "root", None), ("pipe", "ShortPipe", "short", None)]
    assert ("guard", "AuthGuard", "CanActivate", None) in got and ("route", "a", "XComponent", "AuthGuard") in got
    assert {x[1] for x in got if x[0] == "injects"} == {"ApiService", "DataService", "HttpClient"} and {x[1] for x in got if x[0] == "style_url"} == {"./x.css", "./y.css"}
    assert ("input", "item", None, "XComponent") in got and ("output", "done", None, "XComponent") in got


def test_html_and_css():
    assert [x[:2] for x in of("html", "<app-x *ngIf=\"a\" [b]=\"c | short\"></app-x><!-- <app-y> -->\n@if (z) {}")] == [("child", "app-x"), ("directive", "ngIf"), ("binding", "b"), ("pipe", "short"), ("directive", "if")]
    got = of("css", ".a .b, .c:hover { &__part { x: var(--v) } --w: 1px; content: '.no {' }\n/* .d { */ @media (min-width: 3px) { .e {} }\n$breakpoint-s: 3px;\n@keyframes spin { from {} }")
    assert {x[1] for x in got if x[0] == "css_class"} == {"a", "b", "c", "__part", "e"} and ("defines", "--w", "1px", None) in got and ("uses", "--v", None, None) in got
    assert ("media", "(min-width: 3px)", None, None) in got and ("animation", "spin", None, None) in got and ("breakpoint", "$breakpoint-s", "3px", None) in got and ("state", "hover", None, None) in got


def test_state_machines_records_and_markdown():
    asl = '{"StartAt": "A", "States": {"A": {"Resource": "arn:aws:lambda:eu:1:function:fa"}, "B": {"Resource": "arn:aws:states:::lambda:invoke", "Parameters": {"FunctionName": "fb"}}, "P": {"Branches": [{"States": {"C": {"Resource": "arn:aws:lambda:eu:1:function:fc"}}}]}}}'
    assert [x[:2] for x in of("state_machine", asl)] == [("state_machine", "root"), ("lambda_ref", "fa"), ("lambda_ref", "fb"), ("lambda_ref", "fc")] and not of("state_machine", "[1]") and not of("state_machine", "{")
    adr = "id: ADR-L-1\nadr_type: logical\nstatus: accepted\nrelated_adrs: [ADR-L-2]\ndecisions:\n  - id: DEC-1\n    enables: [CAP-1]\ninvariants:\n- {id: INV-1}\ncapabilities: [CAP-1]\n"
    assert sorted(x[:2] for x in of("decision_record", adr)) == [("adr", "ADR-L-1"), ("capability", "CAP-1"), ("decision", "DEC-1"), ("invariant", "INV-1"), ("link", "ADR-L-2"), ("link", "CAP-1")]
    assert not of("decision_record", "id: X\nadr_type: odd\n") and not of("decision_record", "a: [")
    md = "# One #\n```\n# not\n```\n## Two\nsee [x](a/b.md#c) and [y](https://z) for ADR-L-12\n~~~\n# open"
    assert of("markdown", md) == [("heading", "One", "1", None), ("heading", "Two", "2", None), ("internal_link", "a/b.md", "x", None), ("external_link", "https://z", "y", None), ("mention", "ADR-L-12", None, None)]


@pytest.mark.parametrize("reader", sorted(documents.READERS))
@pytest.mark.parametrize("text", ["", "{", "class", "@Component(", "\x00", "@Component({ path:", "[Route(", ".a{", "constructor(", "{path:"])
def test_broken_texts_end(reader, text):
    assert all(len(x) == 5 for x in documents.READERS[reader][0](text))


def test_json_purposes_and_rows(spark, rows):
    files = spark.createDataFrame([(1, "r", "a/controls/x.json", '{"b": {"c": 1}, "a": 2}'), (2, "r", "b/x.json", "{}"), (3, "r", "own/y.json", '{"k": "v"}'), (4, "r", "c/params/x.json", "{bad"), (5, "r", "d/schema/x.json", None), (6, "r", "f.cs", CS)], "file_id long, repo string, file_path string, body string")
    got = documents.json_records(files, {"schema": ["**/own/*.json"]})
    assert rows(got.filter("file_id <> 4")) == [(1, "control", "a", "2"), (1, "control", "b", '{"c":1}'), (3, "schema", "k", "v")] and got.filter("file_id = 4").count() == 0
    assert documents.document_facts(files, "csharp").count() == 5
    assert rows(documents.project_structure(files).filter("mark = 'root'").select("name", "n_files"))[0] == ("a", 1)


def test_advice_by_type_of_change(spark):
    nodes = spark.createDataFrame([("k", "kid", "function", "src/a.py"), ("m", "mid", "class", "src/b.ts"), ("n", "nid", "class", None)], "key string, id string, type string, path string")
    impact = spark.createDataFrame([("k", f"x{i}", 1, "dependents") for i in range(6)] + [("m", "y", 1, "dependencies")], "seed string, node string, depth int, way string")
    got = {r.seed: r for r in context.advice(impact, nodes, "modify").collect()}
    assert (got["k"].risk, got["m"].risk, got["n"].risk) == ("medium", "low", "low") and got["k"].review.startswith("6 dependents") and got["k"].tests == "tests/test_a.py" and got["m"].tests == "b.test.ts,b.spec.ts" and got["n"].tests == ""
    assert {r.risk for r in context.advice(impact, nodes, "delete").collect()} == {"high"} and {r.risk for r in context.advice(impact, nodes, "refactor").collect()} == {"medium"}
    claims = spark.createDataFrame([("y", "c1"), ("m", "c2"), ("z", "c3")], "node string, claim string")
    assert {r.claim for r in context.invalidated(impact.filter(F.col("seed") == "m"), claims).collect()} == {"c1", "c2"}
