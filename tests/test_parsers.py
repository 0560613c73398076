"""Parsers of source artifacts: names at their places, regions, counts; nothing where a text doesn't parse."""

import pytest
from hypothesis import given
from hypothesis import strategies as st

from twinframe.sources import parsers as p

SQL = """CREATE TYPE plan_tier AS ENUM ('a;b','c(');
-- comment ; (
CREATE TABLE IF NOT EXISTS app."customer" (
  id uuid PRIMARY KEY, tier plan_tier NOT NULL, `total amount` numeric(10,2),
  org_id uuid REFERENCES organization (id), CONSTRAINT c UNIQUE (id, tier), FOREIGN KEY (org_id) REFERENCES organization(id));
CREATE UNIQUE INDEX idx_c ON app.customer USING btree (tier, lower(id));
SELECT 1;"""
CODE = """import { Foo, type Bar as Baz } from "./dto/invoice.dto.ts"; import x from 'rxjs';
/* Stripe comment */
export interface InvoiceDto extends Base {
  readonly total: number
  lines?: { nested: string; other: number }[];
  state: "a" | "b",
  call(x: number): void
}
export class InvoiceService { run(a: InvoiceDto) { return a.total + Foo.make({ lines: 1 }) } }
function* gen() {}
"""
SPEC = """openapi: 3.0.0
info: {title: "Acme API"}
paths:
  /invoices/{invoiceId}/lines:
    get:
      operationId: getInvoice
      parameters:
        - name: invoiceId
components:
  schemas:
    Tier: {type: string, enum: [a]}
    Invoice:
      required: [total]
      properties:
        total: {type: number}
        tier: {$ref: "#/components/schemas/Tier"}
"""
DIAGRAM = """@startuml
skinparam Stripe on
actor "Jane Okafor" as jane
actor Ops
abstract   class Invoice {
  +total: int
  pay()
}
jane -> Ops : hi
Invoice <|-- Bill
note left: x
@enduml
"""


def said(names, text):
    assert all(text[s:e] == name for _, _, name, s, e in names)
    return [(kind, name) for _, kind, name, _, _ in names]


def test_sql():
    got = p.sql_names(SQL)
    assert said(got, SQL) == [
        ("enum", "plan_tier"), ("table", "app"), ("table", "customer"), ("column", "id"), ("column", "tier"), ("enum", "plan_tier"), ("column", "total amount"),
        ("column", "org_id"), ("table", "organization"), ("column", "id"), ("table", "organization"), ("column", "id"), ("index", "idx_c"), ("table", "app"),
        ("table", "customer"), ("column", "tier"),
    ]
    assert got[3][0] == "sql::customer.id" and got[9][0] == "sql::organization.id"
    assert p.sql_counts(SQL) == {"statements": 4, "tables": 1, "columns": 4, "constraints": 2, "indexes": 1, "types": 1}


def test_typescript():
    got = p.typescript_names(CODE, "src/a/b")
    assert said(got, CODE) == [
        ("service", "Foo"), ("service", "Baz"), ("path_segment", "dto"), ("path_segment", "invoice.dto"), ("dto", "InvoiceDto"), ("column", "total"),
        ("column", "lines"), ("column", "state"), ("service", "InvoiceService"), ("dto", "InvoiceDto"), ("column", "total"), ("service", "Foo"), ("column", "lines"),
        ("service", "gen"),
    ]
    assert got[0][0] == got[11][0] == "src/a/dto/invoice.dto::Foo" and got[4][0] == "src/a/b::InvoiceDto" and got[5][0] == "ts::property"
    assert [CODE[s:e] for s, e in p.typescript_regions(CODE)] == ["./dto/invoice.dto.ts", "rxjs", "/* Stripe comment */", "a", "b"]


def test_openapi():
    assert said(p.openapi_names(SPEC), SPEC) == [
        ("api", "Acme API"), ("endpoint", "invoices"), ("column", "invoiceId"), ("endpoint", "lines"), ("endpoint", "getInvoice"), ("column", "invoiceId"),
        ("enum", "Tier"), ("dto", "Invoice"), ("column", "total"), ("column", "total"), ("column", "tier"), ("enum", "Tier"),
    ]
    counts = p.openapi_counts(SPEC)
    assert (counts["documents"], counts["schemas"], counts["paths"], counts["operations"], counts["keys"]) == (1, 2, 1, 1, 21)
    assert p.yaml_counts("a: [1, {b: 2}]\n---\nc") == {"documents": 2, "mappings": 2, "sequences": 1, "scalars": 5, "keys": 2, "max_depth": 4}


def test_plantuml():
    assert said(p.plantuml_names(DIAGRAM), DIAGRAM) == [("person", "Jane Okafor"), ("service", "jane"), ("service", "Ops"), ("dto", "Invoice"), ("column", "total"), ("endpoint", "pay")]
    counts = p.plantuml_counts(DIAGRAM)
    assert counts["arrows"] == 2 and counts["declarations"] == 3 and counts["keyword abstract class"] == 1 and p.plantuml_counts("class A") is None
    assert not any("Stripe" in DIAGRAM[s:e] for s, e in p.plantuml_regions(DIAGRAM))


@pytest.mark.parametrize("text", ["create table x (a int", "create table 'x", "select ) (", "/* open"])
def test_broken_sql(text):
    assert p.sql_names(text) == [] and p.sql_counts(text) is None


@pytest.mark.parametrize("text", ["class A {", "let a = 'x", "/* open", "a ]"])
def test_broken_code(text):
    assert p.typescript_names(text) == [] and p.typescript_counts(text) is None and p.typescript_regions(text) is None


@given(st.text(alphabet="abT é\n\t(){}[];:,.'\"`/*-<>|=+@create table interface import from class", max_size=80))
def test_any_text_gives_places_within_it(text):
    for names in (p.sql_names, p.typescript_names, p.openapi_names, p.plantuml_names):
        for _, _, name, s, e in names(text):
            assert 0 <= s < e <= len(text)
    for counts in (p.sql_counts, p.typescript_counts, p.openapi_counts, p.plantuml_counts, p.yaml_counts):
        assert counts(text) is None or all(n >= 0 for n in counts(text).values())
