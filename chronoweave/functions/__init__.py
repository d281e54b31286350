"""chronoweave.functions"""
