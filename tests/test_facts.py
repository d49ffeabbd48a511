import json

import pytest

from graphlens.sources import templates, typescript

TS = """import { a, type B as C } from './x.js';
import D, * as E from "../y";
import 'side';
const f = require('z');
export { g as default, h } from './w';
// call(commented)
export async function load(x: { y: number }): Promise<{ z: number }> {
  helper('not call()');
  return this.http.get<Item[]>('/api/items/1');
}
export class Svc<T> extends Base implements I {
  constructor(private http: HttpClient) { super(); }
  async run(n: number): Promise<void> {
    const q = new Queue(n);
    q.push(/[)]/g.test(s) ? one() : two());
  }
}
export const arrow = async (p: string) => other(p);
setup();
"""


def test_typescript_facts():
    got = typescript.facts(TS)
    of = lambda kind: [(r[1], *r[3:]) for r in got if r[0] == kind]
    assert of("import") == [("./x.js", "a", None), ("./x.js", "B", "C"), ("../y", "default", "D"), ("../y", "*", "E"), ("side", None, None), ("z", None, "require"), ("./w", "default,h", "re-export")]
    assert [x[0] for x in of("export")] == ["default", "h", "load", "Svc", "arrow"]
    assert of("function") == [("load", "async", "exported"), ("arrow", "async", "exported")] and of("class") == [("Svc", "Base", "exported")]
    assert [(n, o) for n, _, o in of("method")] == [("constructor", "Svc"), ("run", "Svc")]
    assert of("construct") == [("Queue", None, "Svc.run")] and of("http") == [("/api/items/1", "GET", "load")]
    assert {(n, o) for n, _, o in of("call")} >= {("helper", "load"), ("one", "Svc.run"), ("two", "Svc.run"), ("other", "arrow"), ("setup", "__module__")}
    assert "commented" not in str(of("call")) and ("push", "q", "Svc.run") in of("method_call")


@pytest.mark.parametrize("text", ["", "class {", "import {", "function (", "`open ${", "const x = (", "export {", "a => {", "new", "import", "class A { x(", "\x00\ud800 é"])
def test_broken_typescript_ends(text):
    typescript.facts(text)


TEMPLATE = """
Parameters:
  Env: {Type: String, Default: dev}
Resources:
  Fn:
    Type: AWS::Serverless::Function
    DependsOn: Q
    Properties:
      Handler: app.main.run
      Environment: {Variables: {TABLE: !Ref T}}
      Events:
        Got: {Type: SQS, Properties: {Queue: !GetAtt Q.Arn}}
        Web: {Type: Api, Properties: {Path: items, Method: post}}
  Q: {Type: AWS::SQS::Queue}
  T:
    Type: AWS::DynamoDB::Table
    Properties:
      TableName: !Sub "${Env}-items"
      KeySchema: [{AttributeName: id, KeyType: HASH}]
      AttributeDefinitions: [{AttributeName: id, AttributeType: S}]
      GlobalSecondaryIndexes: [{IndexName: by-x, KeySchema: [{AttributeName: x, KeyType: HASH}]}]
  A: {Type: AWS::ApiGateway::Resource, Properties: {PathPart: b, ParentId: !Ref P}}
  P: {Type: AWS::ApiGateway::Resource, Properties: {PathPart: a, ParentId: !GetAtt Api.RootResourceId}}
  M: {Type: AWS::ApiGateway::Method, Properties: {HttpMethod: get, ResourceId: !Ref A}}
  O: {Type: AWS::ApiGateway::Method, Properties: {HttpMethod: OPTIONS, ResourceId: !Ref A}}
  R1: {Type: AWS::ApiGatewayV2::Route, Properties: {RouteKey: "PUT /v", Target: !Sub "integrations/${Q}"}}
  R2: {Type: AWS::ApiGatewayV2::Route, Properties: {RouteKey: $connect}}
  R3: {Type: AWS::ApiGatewayV2::Route, Properties: {RouteKey: /any}}
  Map: {Type: AWS::Lambda::EventSourceMapping, Properties: {FunctionName: !Ref Fn, EventSourceArn: !GetAtt [Q, Arn]}}
  Rule: {Type: AWS::Events::Rule, Properties: {ScheduleExpression: rate(1 day), Targets: [{Arn: !GetAtt Fn.Arn}]}}
  C1: {Type: AWS::ApiGateway::Resource, Properties: {PathPart: c, ParentId: !Ref C1}}
Outputs:
  Out: {Value: !Ref Q, Export: {Name: queue}}
"""


def test_template_facts():
    got = templates.facts(TEMPLATE)
    of = lambda kind: sorted(r[1:] for r in got if r[0] == kind)
    assert ("Fn", "explicit", "Q", None) in of("dependency") and ("Fn", "reference", "T", None) in of("dependency") and ("A", "reference", "P", None) in of("dependency")
    assert not [r for r in of("dependency") if r[2] in ("Env", "Api", "C1")]
    assert set(of("endpoint")) == {("/items", "POST", "Fn", "serverless"), ("/a/b", "GET", None, "v1"), ("/v", "PUT", "Q", "v2"), ("$connect", "WEBSOCKET", None, "v2"), ("/any", "ANY", None, "v2")}
    assert set(of("trigger")) == {("Got", "Queue", "Fn", "Q"), ("Web", "Endpoint", "Fn", "/items"), ("Map", "AWS::SQS::Queue", "Fn", "Q"), ("Rule", "Rule", "Fn", "rate(1 day)")}
    assert of("index") == [("by-x", "gsi", "T", "x:HASH")] and of("handler") == [("Fn", "AWS::Serverless::Function", "app.main.run", None)]
    (_, _, table, detail), = of("model")
    assert table == "Env" and json.loads(detail)["keys"] == ["id:HASH"]
    assert of("output") == [("Out", None, "Q", "queue")] and of("environment") == [("Fn", "TABLE", "T", None)]


@pytest.mark.parametrize("text", ["", "Resources: 3", "a: [", "Resources: {A: {Type: AWS::X, Properties: [1]}, B: 2}", "Resources: {A: {Type: AWS::Lambda::Function, Properties: {Events: 3, Environment: 2}}}", "- 1"])
def test_odd_templates_end(text):
    assert all(len(r) == 5 for r in templates.facts(text))


def test_rows_of_files(spark, rows):
    files = spark.createDataFrame([(1, "r", "a.yaml", TEMPLATE), (2, "r", "b.ts", TS), (3, "r", "c.yaml", None), (4, "r", None, TS)], "file_id long, repo string, file_path string, body string")
    assert templates.template_facts(files).filter("kind = 'resource'").count() == 13
    assert rows(typescript.typescript_facts(files).filter("kind = 'class'").select("file_id", "name")) == [(2, "Svc")]
