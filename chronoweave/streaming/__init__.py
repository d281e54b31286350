"""chronoweave.streaming"""
