"""chronoweave.sources"""
