"""The layers' tables, the jobs that fill them and the queries on top."""
