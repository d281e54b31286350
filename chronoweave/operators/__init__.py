"""chronoweave.operators"""
