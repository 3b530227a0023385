"""busline.operators"""
