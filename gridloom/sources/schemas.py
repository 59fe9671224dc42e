"""Declared schemas of the relations; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame

MATCHES = "category string, a_event_id string, a_event_title string, b_event_ticker string, b_event_title string, ordinal bigint"
A_EVENT = "struct<markets:array<struct<question:string,closed:boolean,active:boolean,clobTokenIds:string,outcomes:string,conditionId:string,endDate:string>>>"
B_EVENT = "struct<markets:array<struct<ticker:string,title:string,yes_sub_title:string,no_sub_title:string,subtitle:string,status:string,expiration_time:string>>>"
PAIRS = (
    "a_yes_token string, a_no_token string, a_question string, b_ticker string, b_title string, alignment_type string, score double, a_entity string, b_entity string, "
    "a_end_date string, b_expiration_time string, a_event_id string, a_event_title string, b_event_ticker string, b_event_title string, category string"
)
MANIFEST = (
    "a_yes_token string, a_no_token string, a_question string, b_ticker string, b_title string, score double, a_entity string, b_entity string, a_event_id string, a_event_title string, "
    "b_event_ticker string, b_event_title string, category string, a_end_date string, b_expiration_time string, resolution_date timestamp, days_to_resolution double, date_capped boolean"
)
DATE_COLUMNS = ("a_end_date", "b_expiration_time", "resolution_date", "days_to_resolution", "date_capped")


def demand(df: DataFrame, columns: tuple[str, ...], what: str) -> DataFrame:
    """Fails before planning where a relation lacks columns."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"{what} lacks {', '.join(missing)}")
    return df
