"""Registered queries over the tables of TESTDATA.md, each beside the SQL that gives the same rows."""
