"""Repeat-purchase analytics as Spark jobs: which products will a customer buy again?"""
