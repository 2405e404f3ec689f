"""DuckDB statements that must give the same rows as the core queries."""

from sedimento.plans import catalog_plan, cleaning_plan, found_sql, import_plan, media_plan, tabular_plan, text_plan

SQL: dict[str, str] = {**catalog_plan.SQL, **tabular_plan.SQL, **cleaning_plan.SQL, **text_plan.SQL, **media_plan.SQL, **import_plan.SQL, **found_sql.SQL}
