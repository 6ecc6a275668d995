"""A small relational fixture (SRC9): four tables made by rule, the same on every call."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DEPARTMENTS = ("Engineering", "Marketing", "Finance", "Operations", "Support")
SCHEMAS = {
    "departments": "id int, name string, budget double, location string, head_count int",
    "employees": "id int, name string, department_id int, role string, salary double, hire_date string",
    "products": "id int, name string, category string, price double, stock_quantity int",
    "sales_orders": "id int, product_id int, employee_id int, quantity int, total_amount double, order_date string, status string",
}


def rows() -> dict[str, list[tuple]]:
    price = lambda p: 100.0 + 37.5 * p
    return {
        "departments": [(i, n, 500_000.0 + 250_000.0 * i, f"Site {i}", 4) for i, n in enumerate(DEPARTMENTS, 1)],
        "employees": [(i, f"Employee {i}", 1 + i % 5, ("Analyst", "Engineer", "Lead")[i % 3], 60_000.0 + 2_500.0 * i, f"20{15 + i % 9}-{1 + i % 12:02d}-15") for i in range(1, 21)],
        "products": [(i, f"Product {i}", ("Hardware", "Software")[i % 2], price(i), 15 * i) for i in range(1, 11)],
        "sales_orders": [(i, 1 + i % 10, 1 + i % 20, 1 + i % 4, price(1 + i % 10) * (1 + i % 4), f"2024-{1 + i % 12:02d}-{1 + i % 28:02d}", ("completed", "pending", "cancelled")[i % 3]) for i in range(1, 26)],
    }


def tables(spark: SparkSession) -> dict[str, DataFrame]:
    return {name: spark.createDataFrame(data, SCHEMAS[name]) for name, data in rows().items()}


def register(spark: SparkSession) -> None:
    """As read-only temporary views."""
    for name, df in tables(spark).items():
        df.createOrReplaceTempView(name)
