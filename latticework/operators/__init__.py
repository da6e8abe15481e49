"""Iterative solvers and numerical routines, one system or case per row."""
