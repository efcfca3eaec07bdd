"""The retail tables as a relational schema and a document schema to map them to: the library's own worked example."""

from __future__ import annotations

from docweave.functions.values import Field

DDL = """
CREATE DATABASE retail;
CREATE TABLE customer (
  c_custkey BIGINT PRIMARY KEY, c_name VARCHAR(25) NOT NULL COMMENT 'customer name', c_nationkey INT,
  c_acctbal DECIMAL(12,2) COMMENT 'account balance', c_mktsegment CHAR(10) COMMENT 'market segment');
CREATE TABLE orders (
  o_orderkey BIGINT PRIMARY KEY, o_custkey BIGINT, o_orderstatus CHAR(1) COMMENT 'F=Finished, O=Open, P=Pending',
  o_totalprice DECIMAL(12,2) COMMENT 'total price', o_orderdate DATETIME COMMENT 'order date', o_orderpriority VARCHAR(15) COMMENT 'priority',
  CONSTRAINT fk_cust FOREIGN KEY (o_custkey) REFERENCES customer (c_custkey));
"""

DOCUMENTS = """
{"database": "shop", "collections": {
  "customers": {"_id": "ObjectId", "name": "String -- customer name", "account": {"balance": "Number -- account balance"},
                "market": {"segment": "String -- market segment"}},
  "orders": {"_id": "ObjectId", "customer": {"customerId": "ObjectId -- ref -> customers._id", "name": "String"},
             "status": "String -- finished / open / pending", "total": {"price": "Number -- total price"},
             "dates": {"orderDate": "ISODate -- order date"}, "priority": "String -- priority"}}}
"""

LEGEND = "F=Finished, O=Open, P=Pending"


def field(table: str, name: str, sql_type: str, path: str, bson_type: str, **more) -> Field:
    return Field(table, name, sql_type, more.get("is_pk", False), more.get("references"), more.get("comment"), path, bson_type)


CUSTOMER = [
    field("customer", "c_custkey", "BIGINT", "_id", "ObjectId", is_pk=True),
    field("customer", "c_name", "VARCHAR(25)", "name", "String"),
    field("customer", "c_acctbal", "DECIMAL(12,2)", "account.balance", "Number"),
    field("customer", "c_mktsegment", "CHAR(10)", "market.segment", "String"),
]
ORDERS = [
    field("orders", "o_orderkey", "BIGINT", "_id", "ObjectId", is_pk=True),
    field("orders", "o_custkey", "BIGINT", "customer.customerId", "ObjectId", references="customer.c_custkey"),
    field("orders", "o_orderstatus", "CHAR(1)", "status", "String", comment=LEGEND),
    field("orders", "o_totalprice", "DECIMAL(12,2)", "total.price", "Number"),
    field("orders", "o_orderdate", "DATETIME", "dates.orderDate", "ISODate"),
    field("orders", "o_orderpriority", "VARCHAR(15)", "priority", "String"),
]
